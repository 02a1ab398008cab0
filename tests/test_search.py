"""Query language, ranks, fallback, scopes, hybrid."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators import search
from graphloom.schemas import NODES

ROWS = [
    ("1", "function", "get_depth", "tools.can.get_depth", "tools/can.py", 6, 8, "()", ""),
    ("2", "import", "from tools.can import get_depth", "from tools.can import get_depth", "log/book.py", 3, 3, "", ""),
    ("3", "class", "PlantBed", "garden.plants.PlantBed", "garden/plants.py", 6, 22, "", ""),
    ("4", "method", "create_plant", "garden.plants.PlantBed.create_plant", "garden/plants.py", 9, 16, "", "urls"),
    ("5", "module", "garden.plants", "garden.plants", "garden/plants.py", 1, 22, "", ""),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(ROWS, NODES).persist()


def ids(df) -> set[str]:
    return {r["id"] for r in df.collect()}


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("get_depth", {"1", "2"}), ("plantbed", {"3", "4"}), ("plant", {"4"}), ("plant*", {"3", "4", "5"}), ("plants create", {"4"}), ("depth OR create", {"1", "2", "4"}),
        ("plants NOT create", {"3", "5"}), ('"garden plants"', {"3", "4", "5"}), ("keywords:urls", {"4"}), ("title:urls", set()), ("(create OR get) plant", {"4"}), ("nothing", set()),
    ],
)
def test_language(nodes, query, want):
    assert ids(search.search_nodes(nodes, query)) == want


@pytest.mark.parametrize("bad", ["tools.can", "where is it?", "", "x-y", "AND", "(a", "a OR", "nope:x"])
def test_syntax_errors(bad):
    with pytest.raises(search.QuerySyntaxError):
        search.parse_query(bad)


def test_fallback_in_scope(nodes):
    assert ids(search.search_nodes(nodes, "tools.can")) == {"1", "2"}
    assert ids(search.search_nodes(nodes, "tools.can", scope="log")) == {"2"}


def test_scope_falls_back_to_all(nodes):
    assert ids(search.search_entry_points(nodes, "get_depth", scope="nowhere")) == {"1", "2"}
    assert ids(search.search_entry_points(nodes, "get_depth", scope="TOOLS/")) == {"1"}


def test_two_scopes(spark):
    rows = spark.createDataFrame([("my_app/a.py",), ("myxapp/a.py",), ("MY_APP/b.py",), ("my_app\\c.py",), ("main.py",), ("",)], "p string")
    like = {r[0] for r in rows.where(paths.scope_like(F.col("p"), "my_app")).collect()}
    prefix = {r[0] for r in rows.where(paths.scope_prefix(F.col("p"), "my_app/")).collect()}
    assert like == {"my_app/a.py", "myxapp/a.py", "MY_APP/b.py"} and prefix == {"my_app/a.py", "my_app\\c.py"}
    assert [r[0] for r in rows.select(paths.root_folder(F.col("p"))).collect()] == ["my_app", "myxapp", "MY_APP", "my_app", "main.py", "root"]


def test_hybrid(spark, nodes):
    vectors = spark.createDataFrame([("3", [1.0, 0.0]), ("5", [0.9, 0.1]), ("1", [0.0, 1.0]), ("gone", [1.0, 0.0]), ("2", [1.0, 0.0, 0.0])], "node_id string, vector array<double>")
    got = [(r["id"], round(r["score"], 3)) for r in search.search_hybrid(nodes, "PlantBed", vectors, [1.0, 0.0], 10).collect()]
    assert {g[0] for g in got[:2]} == {"3", "4"} and got[0][1] == got[1][1] == 1.0
    assert got[2] == ("5", 0.994) and got[-1][0] == "1"
    assert search.search_hybrid(nodes, "nothing", vectors, [0.0, 0.0], 3).count() == 2  # of three tied vectors one has no node


def test_exact_name_first(nodes):
    found = search.search_nodes(nodes, "plants")
    assert search.exact_name_first(found, "garden.plants").head()["id"] == "5"


def test_postings_give_what_texts_give(spark, nodes):
    index = search.Index(search.postings(nodes), search.lengths(nodes))
    for query in ("get_depth", "plant*", "plants NOT create", '"garden plants"', "keywords:urls", "(create OR get) plant", "nothing", "depth OR create", "gar* plants", "tools.can", "__"):
        rows = lambda df: sorted((r["id"], round(r["rank_score"], 9)) for r in df.collect())
        assert rows(search.search_nodes(nodes, query, index=index)) == rows(search.search_nodes(nodes, query)), query


def test_folding(spark):
    rows = spark.createDataFrame([("1", "Ångström façade"), ("2", "smørrebrød"), ("3", "Ťažký žlutý kůň"), ("4", "İstanbul"), ("5", "étude"), ("6", "Ελλάδα")], "id string, title string")
    rows = rows.selectExpr("id", "'f' AS node_type", "id AS name", "title", "id AS file_path", "1 AS line_start", "1 AS line_end", "'' AS signature", "'' AS keywords")
    for query, want in (("angstrom", {"1"}), ("FACADE", {"1"}), ("ångström", {"1"}), ("smørrebrød", {"2"}), ("tazky zluty kun", {"3"}), ("etude", {"5"}), ("ελλαδα", {"6"})):
        assert ids(search.search_nodes(rows, query)) == want, query


def test_empty_graph(nodes):
    none = nodes.limit(0)
    assert search.search_nodes(none, "get_depth").count() == 0
    assert search.search_entry_points(none, "x", scope="y").count() == 0
    assert search.search_nodes(none, "x", index=search.Index(search.postings(none), search.lengths(none))).count() == 0
