"""The driver's contract."""

import __spark_entry__ as contract


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["meeting_id", "seq", "start", "end", "speaker", "text"] and df.count() > 0


def test_sql_belongs_to_queries():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80 and all(callable(q) for q in queries.values())
