def test_queries_of_training_text_are_registered():
    import __spark_entry__ as e
    from kassaflow.llm import queries

    assert all(f"p{i}_found" in e.queries() for i in (4, 7, 8)) and "p6_ids" in e.queries()
    assert set(queries.SQL) <= set(queries.QUERIES) <= set(e.queries())
