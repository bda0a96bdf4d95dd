import __spark_entry__ as entry


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 40
    assert entry.entry(spark).count() == 101


def test_operators_are_registered_if_they_are_there():
    names = entry.queries()
    if entry.llm is None:
        assert "pipeline" not in names
    else:
        assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
