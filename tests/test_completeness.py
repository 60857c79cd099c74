from datetime import datetime, timedelta

from kassaflow.operators import completeness as C

T = [datetime(2024, 1, 1) + timedelta(minutes=i) for i in range(20)]
SCHEMA = "delivery_id long, request_id long, data_type int, msg_type int, position long, received_at timestamp, r int, d int"


def test_gate_barrier_and_late(spark):
    data = [
        (1, 1, 1, 2, 3, T[0]), (2, 1, 1, 1, 2, T[1]), (3, 1, 1, 1, 1, T[5]), (4, 1, 1, 1, 1, T[9]), (5, 1, 1, 1, 1, T[5]), (6, 1, 1, 1, None, T[10]),
        (7, 1, 2, 1, 1, T[0]), (8, 1, 2, 2, 4, T[1]), (9, 2, 1, 1, 1, T[0]), (10, 2, 2, 2, 1, T[3]), (11, 2, 2, 2, None, T[3]), (12, 3, 1, 2, None, T[0]),
    ]
    m = spark.createDataFrame([(*x, 0, 0) for x in data], SCHEMA)
    s = C.stream_completeness(m)
    got = {(r.request_id, r.data_type): (r.end_position, r.n_positions, r.n_missing, r.complete, r.completed_at) for r in s.collect()}
    assert got == {(1, 1): (3, 2, 0, True, T[5]), (1, 2): (4, 1, 2, False, None), (2, 1): (None, 1, None, False, None), (2, 2): (1, 0, 0, True, T[3])}
    assert {r.request_id: r.complete for r in C.request_completeness(s, 1).collect()} == {1: True, 2: True}
    assert {r.request_id: r.n_complete for r in C.request_completeness(s).collect()} == {1: 1, 2: 1}
    assert sorted(r.delivery_id for r in C.late_messages(m, s).collect()) == [4, 6]
    assert C.stream_completeness(m.limit(0)).count() == 0
