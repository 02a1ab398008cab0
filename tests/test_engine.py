"""A small source tree: parse, build, change, query."""

from __future__ import annotations

import ast
import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.operators import embed, parse, traverse
from graphloom.sources import files

CAN = '''"""Watering."""


def depth() -> int:
    return int(random())


def water(kind: str, n: int):
    # https://example.org/water
    return kind, depth()
'''
LOG = '''from tools.can import depth


def note(text: str):
    return depth(), text.strip()
'''
PLANTS = '''"""Plants."""

import random


class Bed:
    """Holds plants."""

    def sow(self, kind: str):
        return water(kind, depth())

    def clear(self):
        return depth()
'''
#: Every node that the rules of the front end give for these files: type, path, name, first line.
GOLDEN = [
    ("module", "tools/can.py", "tools.can", 1), ("function", "tools/can.py", "depth", 4), ("function", "tools/can.py", "water", 8),
    ("module", "tools/log.py", "tools.log", 1), ("import", "tools/log.py", "from tools.can import depth", 1), ("function", "tools/log.py", "note", 4),
    ("module", "garden/plants.py", "garden.plants", 1), ("import", "garden/plants.py", "import random", 3), ("class", "garden/plants.py", "Bed", 6), ("method", "garden/plants.py", "sow", 9), ("method", "garden/plants.py", "clear", 12),
    ("function", "<unresolved>", "int", 0), ("function", "<unresolved>", "random", 0), ("function", "<unresolved>", "strip", 0), ("variable", "<unresolved>", "strip", 0),
]


@pytest.fixture()
def tree(tmp_path):
    for name, text in {"tools/can.py": CAN, "tools/log.py": LOG, "garden/plants.py": PLANTS, ".hidden/x.py": "a = 1", "build/y.py": "b = 1", "notes.txt": "no"}.items():
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path


def engine_of(spark, tree) -> tuple[Engine, str]:
    return Engine(spark, f"file://{tree}/store"), f"file://{tree}/src"


def node(e: Engine, name: str) -> str:
    return e.nodes.where((F.col("name") == name) & (F.col("file_path") != "<unresolved>")).head()["id"]


def test_golden_graph(spark, tree):
    e, root = engine_of(spark, tree)
    snap = e.index(root)
    ids = sorted(hashlib.sha256(":".join(map(str, x)).encode()).hexdigest() for x in GOLDEN)
    assert {r["id"] for r in e.nodes.collect()} == set(ids)
    assert (snap["node_count"], snap["edge_count"], snap["file_count"]) == (15, 17, 3)
    assert snap["snapshot_hash"] == hashlib.sha256("|".join(ids).encode()).hexdigest()
    assert {r["edge_type"]: r["count"] for r in e.edges.groupBy("edge_type").count().collect()} == {"imports": 2, "defines": 4, "contains": 2, "calls": 8, "references": 1}
    nodes, score = e.blast_radius(node(e, "depth"))
    assert {r["name"]: r["depth"] for r in nodes.collect()} == {"tools.can": 1, "sow": 1, "clear": 1, "water": 1, "note": 1, "Bed": 2, "tools.log": 2, "garden.plants": 3}
    assert (score.head()["affected_count"], score.head()["confidence"], len(score.head()["risk_reasons"])) == (8, 0.5, 4)
    c = e.context(node(e, "Bed"), 5, "garden")
    assert {r["name"] for r in c.nodes.collect()} == {"sow", "clear"} and c.edges.count() == 5
    assert {r["name"] for r in c.external.collect()} == {"water", "depth"}
    folders = {r["folder"]: r for r in e.feature_map().collect()}
    assert folders["<unresolved>"]["functions"] == ["int", "random", "strip"] and folders["garden"]["methods_count"] == 2 and folders["tools"]["classes"] == []
    found = e.search("depth", scope="nowhere")
    assert {r["type"] for r in found.collect()} == {"function", "import"} and found.count() == 2
    with pytest.raises(traverse.UnknownNode):
        e.context("none")


def test_incremental_equals_full(spark, tree):
    e, root = engine_of(spark, tree)
    first = e.index(root)
    assert e.index(root)["indexed_at"] == first["indexed_at"]
    (tree / "src/tools/can.py").write_text("# moved\n" + CAN)
    (tree / "src/tools/log.py").unlink()
    (tree / "src/garden/extra.py").write_text("from garden.base import Base\n\nLIMIT = 3\n\n\nclass Extra(Base):\n    size = 1\n\n    def run(self):\n        return note(self.size)\n")
    changed = e.index(root)
    assert changed["snapshot_hash"] != first["snapshot_hash"] and changed["file_count"] == 3
    other = Engine(spark, f"file://{tree}/other")
    assert other.index(root)["snapshot_hash"] == changed["snapshot_hash"]
    for table in ("edges", "edges_in", "postings", "lengths"):
        assert sorted(map(str, other.store.read(table).collect())) == sorted(map(str, e.store.read(table).collect()))
    assert e.index(root, full=True)["snapshot_hash"] == changed["snapshot_hash"]
    e.store.prune()
    assert e.status()["snapshot_hash"] == changed["snapshot_hash"]


def test_two_roots_and_embeddings(spark, tree):
    e, root = engine_of(spark, tree)
    (tree / "more/lib").mkdir(parents=True)
    (tree / "more/lib/z.py").write_text("def zeta():\n    return 1\n")
    e.index(root, vectors=embed.hashed_vectors)
    vectors = e.embeddings.count()
    assert vectors == e.nodes.where("node_type <> 'import'").count()
    assert e.nodes.where("name = 'water'").head()["keywords"] == "https://example.org/water"
    e.index(f"file://{tree}/more")
    assert e.nodes.where("name in ('zeta', 'water')").count() == 2


def test_parser_rules():
    source = "import os, sys\nXX = 1\n_ = 2\n__all__ = []\nself.y = XX\n\n\n@deco\ndef f(a, b=(1, 2)):\n    def g():\n        return obj.attr.go(a)\n    return g()\n\n\nclass A(B, c.D):\n    async def m(self):\n        pass\n\n\nprint(f(1))\n"
    nodes, edges = parse.parse_python("pkg/mod.py", source)
    by = {(n[1], n[2]): n for n in nodes if n[4] != "<unresolved>"}
    assert by["function", "f"][5:8] == (8, 12, "(a, b=(1, 2))") and by["function", "g"][3] == "pkg.mod.f.g"
    assert by["method", "m"][3] == "pkg.mod.A.m" and by["class", "B"][4:6] == ("pkg/mod.py", 0) and ("class", "D") not in by
    assert by["import", "import os, sys"][5] == 1 and ("variable", "XX") in by and ("variable", "_") not in by and ("variable", "__all__") not in by
    name = {n[0]: n[2] for n in nodes}
    said = {(name[a], name[b], k) for a, b, k in edges}
    assert {("g", "go", "calls"), ("f", "g", "calls"), ("g", "attr", "references"), ("A", "m", "contains"), ("f", "g", "defines")} <= said
    assert not any(a == "pkg.mod" and k == "calls" for a, b, k in said)
    assert len(parse.parse_python("bad.py", "def (:\n")[0]) == 1


def test_plugin_rule_takes_a_call():
    class Route:
        handled_names = ("path",)

        def handle_call(self, name: str, call: ast.Call, caller: str, out) -> None:
            out.edge(caller, out.stub("function", call.args[1].id), "route")

    nodes, edges = parse.parse_python("urls.py", "u = [path('x', view)]\n", [Route()])
    assert [k for _, _, k in edges if k == "route"] == ["route"]


def test_dependency_files():
    assert files.dependencies("a/requirements.txt", "Django==4.2\nfastapi>=0.1 # x\n-r b\nuvicorn[standard]\n") == {"django", "fastapi", "uvicorn"}
    assert files.dependencies("pyproject.toml", '[project]\ndependencies = ["A>=1", "b; x"]\n[tool.poetry.dependencies]\npython = "3"\nc = "1"\n') == {"a", "b", "c"}
    assert files.dependencies("package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}') == {"react", "vite"}
    assert files.dependencies("package.json", "{") == set()


def test_watch(spark, tree):
    from graphloom.streaming.builds import watch

    e, root = engine_of(spark, tree)
    q = watch(e, root, f"file://{tree}/checkpoint")
    q.awaitTermination(120)
    assert e.status()["file_count"] == 3


def test_a_build_that_dies_changes_nothing(spark, tree, monkeypatch):
    from graphloom.sources import store

    e, root = engine_of(spark, tree)
    first, edges = e.index(root), {tuple(r) for r in e.edges.collect()}
    for step in ("edges", "postings", "snapshot"):
        (tree / "src/tools/more.py").write_text(f"def more_{step}():\n    return note({{}})\n")
        write = store.Version._write

        def dies(self, table, df, step=step, write=write):
            if table == step:
                raise OSError("gone")
            return write(self, table, df)

        with monkeypatch.context() as m:
            m.setattr(store.Version, "_write", dies)
            with pytest.raises(OSError, match="gone"):
                e.index(root)
        again = Engine(spark, e.store.path)
        assert again.status()["snapshot_hash"] == first["snapshot_hash"] and {tuple(r) for r in again.edges.collect()} == edges
    with monkeypatch.context() as m:
        m.setattr(store.GraphStore, "point", lambda self, number, tables: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            e.index(root)
    assert e.status()["snapshot_hash"] == first["snapshot_hash"]
    assert e.index(root)["snapshot_hash"] != first["snapshot_hash"]
    late = e.store.begin()
    e.store.write(stubs=e.store.read("stubs"))
    with pytest.raises(store.ConflictingWrite):
        late.commit()
    e.store.prune()
    assert e.search("more_snapshot").count() == 1


def test_only_changed_tables_are_written(spark, tree):
    e, root = engine_of(spark, tree)
    e.index(root)
    before = e.store.pointer()[1]
    e.store.write(embeddings=e.embeddings)
    after = e.store.pointer()[1]
    assert {k for k in after if before[k] != after[k]} == {"embeddings"}


def test_commands(spark, tree, capsys):
    from graphloom.__main__ import main

    (tree / "more/lib").mkdir(parents=True)
    (tree / "more/lib/z.py").write_text("def zeta():\n    return 1\n")
    run = lambda *a: (main(["--store", f"file://{tree}/cli", *a], spark), capsys.readouterr().out)[1]
    said = dict(x.split("\t") for x in run("index", f"file://{tree}/src", f"file://{tree}/more").strip().splitlines())
    assert said["paths_indexed"] == "2" and said["files"] == "4" and len(said["snapshot_hash"]) == 16
    assert "node_count" in run("status")
    row = run("search", "zeta").strip().split("\t")
    assert row[:2] == ["function", "lib.z.zeta"] and row[2] == "lib/z.py:1" and row[3] == "1.00" and len(row[4]) == 12
    assert '"depth_reached":1' in run("context", "Bed", "--scope", "garden")
    lines = run("impact", "depth").strip().splitlines()
    assert '"affected_count":8' in lines[0] and [x.split("\t")[0] for x in lines[1:]] == sorted(x.split("\t")[0] for x in lines[1:])
    assert '"folder":"lib"' in run("map")


def test_generic_rules_and_broken_files():
    class Hook:
        handled_names, generic = (), True

        def handle_any_call(self, name, call, caller, out) -> None:
            if name.startswith("use"):
                out.edge(caller, out.stub("function", name), "hook")

    nodes, edges = parse.parse_python("a.py", "def f():\n    use_state()\n    other()\n\nuse_state()\n", [Hook()])
    assert [k for _, _, k in edges if k in ("hook", "calls")] == ["hook"]
    source = "import os\n\n\n@deco\ndef good(a):\n    return os.sep\n\n\ndef bad(:\n    pass\n\n\nclass Fine:\n    def m(self):\n        return 1\n"
    nodes, _ = parse.parse_python("b.py", source)
    got = {(n[1], n[2]): n[5:7] for n in nodes if n[4] == "b.py"}
    assert got["function", "good"] == (4, 6) and got["method", "m"] == (14, 15) and ("function", "bad") not in got and got["import", "import os"] == (1, 1)


def test_repeated_ids_do_not_multiply(spark):
    from graphloom.operators import build
    from graphloom.schemas import NODES

    row = lambda i, title: (i, "function", i, title, "a.py", 1, 2, "", "")
    old = spark.createDataFrame([row("a", "x"), row("b", "x")], NODES)
    new = spark.createDataFrame([row("a", "y"), row("a", "z"), row("c", "x")], NODES)
    assert sorted((r["id"], r["title"]) for r in build.upsert_nodes(old, new).collect()) == [("a", "z"), ("b", "x"), ("c", "x")]
    words = spark.createDataFrame([("a", "k1"), ("a", "k2")], "id string, keywords string")
    assert sorted((r["id"], r["keywords"]) for r in build.update_keywords(old, words).collect()) == [("a", "k2"), ("b", "")]


def test_vectors_by_a_model_and_by_hashes(spark):
    texts = spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", "one two two"), ("d", None)], "node_id string, text string")
    made = embed.model_vectors(texts.na.fill(""), lambda: lambda batch: [[float(len(x)), 1.0] for x in batch], chunk=2)
    assert {r["node_id"]: (list(r["vector"]), r["dims"]) for r in made.collect()} == {"a": ([11.0, 1.0], 2), "b": ([0.0, 1.0], 2), "c": ([11.0, 1.0], 2), "d": ([0.0, 1.0], 2)}
    hashed = {r["node_id"]: list(r["vector"]) for r in embed.hashed_vectors(texts, 16).collect()}
    want = [0.0] * 16
    for w in ("one", "two", "two"):
        h = hashlib.md5(w.encode()).hexdigest()
        want[int(h[:8], 16) % 16] += 1.0 if int(h[8:10], 16) % 2 == 0 else -1.0
    norm = sum(x * x for x in want) ** 0.5
    assert hashed["a"] == hashed["c"] == pytest.approx([x / norm for x in want]) and hashed["b"] == hashed["d"] == [0.0] * 16


def test_open_store(spark, tree, monkeypatch):
    from graphloom.sources.store import GraphStore

    with pytest.raises(FileNotFoundError):
        GraphStore.open(spark, f"file://{tree}/none")
    e, root = engine_of(spark, tree)
    e.index(root)
    assert GraphStore.open(spark, e.store.path) is GraphStore.open(spark, e.store.path)
    monkeypatch.setenv("GRAPHLOOM_STORE", e.store.path)
    assert GraphStore.open(spark).snapshot()["file_count"] == 3 and isinstance(embed.backends(), list)


def test_clock_stream_sees_deleted_files(spark, tree):
    import time

    from graphloom.streaming.builds import watch

    e, root = engine_of(spark, tree)
    q = watch(e, root, f"file://{tree}/ticks", every="1 second")

    def until(n: int) -> None:
        end = time.time() + 120
        while (row := e.status()) is None or row["file_count"] != n:
            assert time.time() < end and q.isActive, q.exception()
            time.sleep(0.5)

    try:
        until(3)
        (tree / "src/tools/log.py").unlink()
        until(2)
    finally:
        q.stop()
    assert e.nodes.where("file_path = 'tools/log.py'").count() == 0


def test_single_nodes(spark, tree):
    e, root = engine_of(spark, tree)
    e.index(root)
    bed = node(e, "Bed")
    assert e.store.exists(bed) and not e.store.exists("none") and e.store.get(bed)["title"] == "garden.plants.Bed"
    with pytest.raises(KeyError):
        e.store.get("none")
    assert e.named("Bed") == bed and e.index([root, root])["file_count"] == 3
    e.store.clear()
    assert e.nodes.count() == 0 and e.status() is None and e.store.current() is not None
