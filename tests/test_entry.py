import __spark_entry__ as entry


def test_contract(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {"p1_found", "p4_found", "p5_found"} <= set(q) and len(q) > 60
