import oracle
import pytest

from stratalens.plans import agents, catalog, wires  # these add their queries to the catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sf, name):
    oracle.compare(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


def test_without_sql(spark, sf):
    p = catalog.mcnemar_p(spark, sf).first()
    assert 0 <= p["p_value"] <= 1
    names = [tuple(r) for r in catalog.section_names(spark, sf).collect()]
    assert len({(a, c) for a, _, c in names}) == len(names)


def test_stream_gives_the_closed_sessions(spark, sf):
    closed = {tuple(r)[:2] for r in catalog.debounce_stream(spark, sf).select("user_id", "n").collect()}
    every = {tuple(r) for r in catalog.debounce_sessions(spark, sf).select("user_id", "n").collect()}
    assert closed and closed <= every


def test_all_queries_are_compared():
    assert {agents.turn_actions.__name__, wires.events_chat.__name__} <= set(catalog.ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
