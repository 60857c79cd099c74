from kassaflow.operators.setops import differences
from kassaflow.plans import sales

HEAD = {
    "transactions": "transaction_id,store_id,payment_method_id,voucher_id,user_id,original_amount,discount_applied,final_amount,created_at",
    "transaction_items": "transaction_id,item_id,quantity,unit_price,subtotal,created_at",
    "users": "user_id,gender,birthdate,registered_at",
    "stores": "store_id,store_name,street,postal_code,city,state,latitude,longitude",
    "menu_items": "item_id,item_name,category,price,is_seasonal,available_from,available_to",
}


def write(root, table, *lines):
    (root / f"{table}.csv").write_text("\n".join([HEAD[table], *lines]) + "\n")


def test_all_five_on_csv(spark, tmp_path):
    write(tmp_path, "transactions",
          "t1,1,1,,10.0,80,0,80.00,2024-01-01 05:59:59", "t2,1,1,,10,80,0,80.00,2024-01-01 06:00:00", "t2,1,1,,10,80,0,80.00,2024-01-01 06:00:00",
          "t3,1,1,,11,75,0,75,2024-06-30 23:59:59", "t4,2,1,,,75,0,74.99,2024-07-01 10:00:00", "t5,9,1,,12,75,0,abc,2024-07-01 10:00:00",
          "t6,2,1,,13,75,0,76,2026-07-01 10:00:00", "t7,2,1,,14,75,0,76,2025-07-01 10:00:00")
    write(tmp_path, "transaction_items", "t1,1,2,1,2.5,2024-01-02 00:00:00", "t1,2,3,1,1.0,2024-01-02 00:00:00", "t1,3,5,1,,2024-01-02 00:00:00", "t1,7,1,1,9,2024-02-02 00:00:00")
    write(tmp_path, "users", "10,f,1990-01-01,2024-01-01 00:00:00", "14.0,f,1991-01-01,2024-01-01 00:00:00")
    write(tmp_path, "stores", '1,"One, Hof",a,1,b,c,1,1', "2,Two,a,1,b,c,1,1")
    write(tmp_path, "menu_items", "1,Tea,food,1,True,,", "2,Mocha,food,1,True,,")
    got = {k: [tuple(map(str, r)) for r in df.collect()] for k, df in sales.run_all(sales.from_csv(spark, str(tmp_path))).items()}
    assert got["q1"] == [("t2", "80.00"), ("t3", "75.00"), ("t7", "76.00")]
    assert got["q2_a"] == [("2024-01", "Mocha", "3"), ("2024-02", "7", "1")]
    assert got["q2_b"] == [("2024-01", "Tea", "2.50"), ("2024-02", "7", "9.00")]
    assert got["q3"] == [("2024-H1", "One, Hof", "235.00"), ("2024-H2", "Two", "74.99"), ("2025-H2", "Two", "76.00")]
    assert got["q4"] == [("One, Hof", "11"), ("One, Hof", "1990-01-01"), ("Two", "1991-01-01")]


def test_nothing_passes_gives_empty_frames_with_schema(spark, tmp_path):
    for t in HEAD:
        write(tmp_path, t)
    for df in sales.run_all(sales.from_csv(spark, str(tmp_path))).values():
        assert df.count() == 0 and len(df.columns) >= 2
    assert differences(spark.range(1), spark.range(1)).count() == 0
