"""Every graph query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import assert_same, connect

from graphloom.plans import registry


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, small, name):
    assert_same(spark, con, small, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_embed_text_of_every_kind(spark, small):
    from graphloom.plans.derived import Derived

    nodes = Derived(spark, small).nodes.where("node_type <> 'import'")
    assert nodes.select("node_type").distinct().count() > 1
    assert registry.queries()["embed_text_nodes"](spark, small).count() == nodes.count()


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_stored_edges_are_numbers_in_the_order_of_ids(spark, small):
    """F3 to F7: ids stand in the nodes alone, and a number's order is its id's."""
    from graphloom.plans.derived import Derived

    g = Derived(spark, small).kept()
    assert dict(g.links.dtypes) == dict(g.links_in.dtypes) == {"source_id": "int", "target_id": "int", "edge_type": "string"}
    rows = sorted((r["number"], r["id"]) for r in g.store.select("number", "id").collect())
    assert [n for n, _ in rows] == list(range(len(rows))) and [i for _, i in rows] == sorted(i for _, i in rows)


def test_names_are_resolved_without_a_stored_graph(spark, small, monkeypatch):
    """the nodes are read once, so no table of all nodes is written, and what is written holds nodes asked for alone."""
    from graphloom.operators import build
    from graphloom.plans import derived

    monkeypatch.setattr(derived, "KEPT", {})
    stored, met = [], []
    put, write = derived.written, build.written
    monkeypatch.setattr(derived, "written", lambda spark, df, name: stored.append(name) or put(spark, df, name))
    monkeypatch.setattr(build, "written", lambda spark, df, name: met.append((name, out := write(spark, df, name))) or out)
    assert registry.queries()["resolve_names"](spark, small).count() > 0
    assert not stored
    kinds = {r["id"] for r in dict(met)["nodes-asked-for"].collect()}
    assert kinds and kinds <= {r["id"] for r in derived.Derived(spark, small).parts["part"].select("id").collect()}


def test_a_name_gives_a_known_edge_once(spark):
    """no distinct over what a hot name gives, and still no edge twice."""
    from graphloom.operators import build
    from graphloom.schemas import NODES, UNRESOLVED

    node = lambda i, name, path: (i, "function", name, name, path, 1, 2, "", "")
    known = spark.createDataFrame([node("a", "f", "x"), node("b", "f", "y"), node("c", "g", "y")], NODES)
    stubs = spark.createDataFrame([node("s", "f", UNRESOLVED), node("t", "f", UNRESOLVED), node("u", "none", UNRESOLVED)], NODES)
    raw = spark.createDataFrame([("c", "a", "calls"), ("c", "s", "calls"), ("c", "t", "calls"), ("c", "u", "calls"), ("a", "b", "calls"), ("a", "s", "uses"), ("a", "z", "calls")], "source_id string, target_id string, edge_type string")
    edges, needed = build.resolve_names(raw, known, stubs)
    want = [("a", "a", "uses"), ("a", "b", "calls"), ("a", "b", "uses"), ("c", "a", "calls"), ("c", "b", "calls"), ("c", "u", "calls")]
    assert sorted((r["source_id"], r["target_id"], r["edge_type"]) for r in edges.collect()) == want
    assert [r["id"] for r in needed.collect()] == ["u"]
