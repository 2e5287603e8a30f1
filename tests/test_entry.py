import __spark_entry__ as entry


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "bm25_or" in q
    assert entry.entry(spark).columns == ["rank", "chunk_id", "file_path", "score"]
