"""Traversal on small graphs: cycles, missing ends, long and short ways."""

from __future__ import annotations

import pytest

from graphloom.operators import traverse
from graphloom.schemas import EDGES, NODES


def graph(spark, names: str, links: str, paths: dict[str, str] | None = None):
    nodes = spark.createDataFrame([(n, "function", n, n, (paths or {}).get(n, f"f/{n}.py"), 1, 2, "", "") for n in names], NODES)
    edges = spark.createDataFrame([(a, b, "calls") for a, b in links.split()], EDGES)
    return nodes, edges


def depths(df) -> dict[str, int]:
    return {r["id"]: r["depth"] for r in df.collect()}


def test_cycle_is_left(spark):
    nodes, edges = graph(spark, "abc", "ab bc ca")
    assert depths(traverse.blast_radius(nodes, edges, "a")) == {"c": 1, "b": 2}


def test_missing_sources_count_but_lead_no_further(spark):
    nodes, edges = graph(spark, "ab", "xb bx ax ba".replace("bx", "yx"))
    reached = traverse.impact(nodes, edges, "b")
    assert {(r["id"], r["depth"], r["present"]) for r in reached.collect()} == {("x", 1, False)}


def test_depth_bound_and_discovery_edge(spark):
    nodes, edges = graph(spark, "abcde", "ba ca db dc ed")
    got = {r["id"]: (r["depth"], r["via_id"]) for r in traverse.blast_radius(nodes, edges, "a", 2).collect()}
    assert got == {"b": (1, "a"), "c": (1, "a"), "d": (2, "b")}


def test_score_reasons(spark):
    nodes, edges = graph(spark, "abcdefgh", "ba ca da ea fa ga hb".replace("hb", "hb"), {"h": "other/h.py"})
    row = traverse.blast_score(nodes, edges, "a").head()
    assert row["affected_count"] == 7 and row["confidence"] == 0.55 and len(row["risk_reasons"]) == 3
    assert row["risk_reasons"][1] == "Cross-module impact: h."


def test_score_of_untouched_test_file(spark):
    nodes, edges = graph(spark, "a", "zz", {"a": "tests/a.py"})
    row = traverse.blast_score(nodes, edges, "a").head()
    assert (row["affected_count"], row["confidence"], row["risk_reasons"]) == (0, 1.0, [])


def test_context_scope_and_external(spark):
    nodes, edges = graph(spark, "abcd", "ab bc cd ax", {"a": "in/a.py", "b": "in/b.py", "c": "out/c.py", "d": "in/d.py"})
    c = traverse.Context(nodes, edges, "a", 3, "in/")
    assert depths(c.nodes) == {"b": 1}
    assert [r["id"] for r in c.external.collect()] == ["c"]
    assert {(r["source_id"], r["target_id"]) for r in c.edges.collect()} == {("a", "b"), ("a", "x"), ("b", "c")}
    assert c.depth_reached.head()[0] == 1


def test_context_external_at_last_depth(spark):
    nodes, edges = graph(spark, "ab", "ab", {"a": "in/a.py", "b": "out/b.py"})
    assert [r["id"] for r in traverse.Context(nodes, edges, "a", 0, "in").external.collect()] == ["b"]


def test_depth_first_differs_on_long_first_way(spark):
    # a -> b -> c -> d by the first edge; a -> c is shorter, but c was visited at depth 2
    nodes, edges = graph(spark, "abcde", "ab bc ac cd de")
    first = traverse.context_depth_first(nodes, edges, "a", 3)
    assert first["nodes"] == ["b", "c", "d"] and first["depth_reached"] == 3
    assert depths(traverse.Context(nodes, edges, "a", 3).nodes) == {"b": 1, "c": 1, "d": 2, "e": 3}


def test_unknown_entry(spark):
    nodes, _ = graph(spark, "a", "aa")
    with pytest.raises(traverse.UnknownNode):
        traverse.require_node(nodes, "zzz")


def test_only_new_nodes_are_followed(spark):
    nodes, edges = graph(spark, "abcdef", "ba cb dc ac bd ea fe be")
    got = depths(traverse.blast_radius(nodes, edges, "a", 9))
    assert got == {"b": 1, "e": 1, "c": 2, "d": 2, "f": 2} or got == {"b": 1, "e": 1, "c": 2, "f": 2, "d": 3}


@pytest.mark.parametrize(("listed", "sent"), [(64, 1 << 18), (0, 1 << 18), (0, 0)])
def test_frontiers_of_any_size(spark, monkeypatch, listed, sent):
    import random

    rng = random.Random(5)
    names = "abcdefghijklmnopqrst"
    links = {rng.choice(names) + rng.choice(names + "XYZ") for _ in range(45)}
    nodes, edges = graph(spark, names, " ".join(sorted(links)))
    monkeypatch.setattr(traverse, "MOST_LISTED", listed)
    monkeypatch.setattr(traverse, "MOST_SENT", sent)
    for reverse in (False, True):
        far, depth = {"a": 0}, 0
        while depth < 4:
            depth += 1
            for x in sorted(links):
                a, b = (x[1], x[0]) if reverse else (x[0], x[1])
                if far.get(a) == depth - 1 and a in names:
                    far.setdefault(b, depth)
        got = {r["id"]: r["depth"] for r in traverse._reach(nodes, edges, "a", 4, reverse).collect()}
        assert got == far


def test_affected_rows_are_sorted(spark):
    from graphloom.operators import display

    nodes, edges = graph(spark, "abcd", "da ca ba")
    assert [r["title"] for r in display.affected_rows(traverse.blast_radius(nodes, edges, "a")).collect()] == ["b", "c", "d"]


def test_context_result(spark):
    nodes, edges = graph(spark, "abc", "ab bc", {"a": "in/a.py", "b": "in/b.py", "c": "out/c.py"})
    row = traverse.Context(nodes, edges, "a", 3, "in").result().head()
    assert [x["name"] for x in row["nodes"]] == ["b"] and len(row["edges"]) == 2 and [x["title"] for x in row["external_deps"]] == ["c"] and row["depth_reached"] == 1 and row["note"].startswith("1 ")
    assert traverse.Context(nodes, edges, "a", 3).result().head()["note"] is None
