"""Front end for Python sources: one file in, its nodes and raw edges out, by the standard library's syntax trees.

Rules. A module has a node over all lines. A function's or class's span starts at its first decorator. Titles are dotted from the
module on. A function right inside a class is a method (contains), any other is defined by the nearest registered parent; classes
are defined by the module. An import's name is its text. A class inherits from each base that is a plain name, as a stand-in class
of the same file at line 0. Variables are assigned in the module's or a class's own body. In functions, an attribute's name is a
reference and a call's last name is a call, both to stand-ins at `<unresolved>`; calls outside of functions are none.
Of a file that does not parse, the statements at its left margin that do parse are read; the others are passed over. Rules of plugins
are asked first, by the called name; rules that are `generic` see every other call inside a function, in place of its edge.

Other languages come as other functions from (path, text) to rows: brace_languages has some, by scans, as no grammars are here.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.functions.ids import node_id_of
from graphloom.schemas import EDGE_COLUMNS, NODE_COLUMNS, PARSED, UNRESOLVED
from graphloom.shipping import ship

Rows = list[tuple]
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
LEAST_REFERENCE, LEAST_VARIABLE = 3, 2


def module_name(path: str) -> str:
    p = path.replace("\\", "/")
    for s in (".py", ".tsx", ".ts", ".jsx", ".mjs", ".js", ".go", ".rs"):
        if p.endswith(s):
            p = p[: -len(s)]
            break
    return p.replace("/", ".")


class Collector:
    """Gathers rows of one file."""

    def __init__(self, path: str):
        self.path, self.nodes, self.edges = path, {}, {}

    def node(self, kind: str, name: str, title: str, first: int, last: int, signature: str = "", path: str | None = None) -> str:
        where = self.path if path is None else path
        key = node_id_of(kind, where, name, first)
        self.nodes.setdefault(key, (key, kind, name, title, where, first, last, signature, ""))
        return key

    def stub(self, kind: str, name: str) -> str:
        return self.node(kind, name, name, 0, 0, path=UNRESOLVED)

    def edge(self, source: str, target: str, kind: str) -> None:
        self.edges[source, target, kind] = None


def _called(f: ast.expr) -> str:
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""


def _signature(text: list[str], node: ast.AST, source: str) -> str:
    """The parameter list as written, with its parentheses."""
    segment = ast.get_source_segment(source, node) or ""
    at = segment.find("(", segment.find("def "))
    depth = 0
    for i in range(at, len(segment)) if at >= 0 else ():
        depth += (segment[i] in "([{") - (segment[i] in ")]}")
        if depth == 0:
            return segment[at : i + 1]
    return "()"


def _recovered(source: str) -> ast.Module | None:
    """The tree of what parses: statements that start at the left margin, with their decorators and else branches, each on its own."""
    lines = source.split("\n")
    starts: list[int] = []
    open_decorator = False
    for i, x in enumerate(lines):
        if x and not x[0].isspace() and x[0] not in ")]}#" and not re.match(r"(else|elif|except|finally)\b", x):
            if not open_decorator:
                starts.append(i)
            open_decorator = x[0] == "@"
    kept = [""] * len(lines)
    for i, j in zip(starts, [*starts[1:], len(lines)], strict=True):
        try:
            ast.parse("\n".join(lines[i:j]))
        except (SyntaxError, ValueError, RecursionError):
            continue
        kept[i:j] = lines[i:j]
    try:
        return ast.parse("\n".join(kept))
    except (SyntaxError, ValueError, RecursionError):
        return None


def parse_python(path: str, source: str, rules: Iterable = ()) -> tuple[Rows, Rows]:
    """Nodes and raw edges of one file. Rules: objects with handled_names and handle_call(name, call, caller, collector)."""
    out = Collector(path)
    lines = source.split("\n")
    name = module_name(path)
    module = out.node("module", name, name, 1, max(1, len(lines) - (lines[-1] == "" and len(lines) > 1)))
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        tree = _recovered(source)
        if tree is None:
            return list(out.nodes.values()), []
    rules = list(rules)
    by_name = {n: r for r in rules for n in r.handled_names}
    generic = [r for r in rules if getattr(r, "generic", False)]

    def variables(body: list[ast.stmt], parent: str, scope: list[str]) -> None:
        for s in body:
            targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, (ast.AnnAssign, ast.AugAssign)) else []
            for t in targets[:1]:
                if isinstance(t, ast.Name) and len(t.id) >= LEAST_VARIABLE and t.id not in ("self", "cls") and not (t.id.startswith("__") and t.id.endswith("__")):
                    out.edge(parent, out.node("variable", t.id, ".".join([*scope, t.id]), s.lineno, s.end_lineno), "defines" if parent == module else "contains")

    def walk(node: ast.AST, scope: list[str], parent: str, in_class: bool, caller: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, FUNCTIONS):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                title = [*scope, child.name]
                me = out.node("method" if in_class else "function", child.name, ".".join(title), first, child.end_lineno, _signature(lines, child, source))
                out.edge(parent, me, "contains" if in_class else "defines")
                walk(child, title, me, False, me)
            elif isinstance(child, ast.ClassDef):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                title = [*scope, child.name]
                me = out.node("class", child.name, ".".join(title), first, child.end_lineno)
                out.edge(module, me, "defines")
                for b in child.bases:
                    if isinstance(b, ast.Name):
                        out.edge(me, out.node("class", b.id, b.id, 0, 0), "inherits")
                variables(child.body, me, title)
                walk(child, title, me, True, caller)
            else:
                if isinstance(child, (ast.Import, ast.ImportFrom)):
                    text = ast.get_source_segment(source, child) or ""
                    out.edge(module, out.node("import", text, text, child.lineno, child.end_lineno), "imports")
                if isinstance(child, ast.Call):
                    called = _called(child.func)
                    rule = by_name.get(called)
                    if rule is not None:
                        rule.handle_call(called, child, caller or module, out)
                    elif called and caller and generic:
                        for r in generic:
                            r.handle_any_call(called, child, caller, out)
                    elif called and caller:
                        out.edge(caller, out.stub("function", called), "calls")
                if isinstance(child, ast.Attribute) and caller and len(child.attr) >= LEAST_REFERENCE:
                    out.edge(caller, out.stub("variable", child.attr), "references")
                walk(child, scope, parent, in_class and not isinstance(child, ast.expr), caller)

    variables(tree.body, module, [name])
    walk(tree, [name], module, False, None)
    return list(out.nodes.values()), list(out.edges)


FRONT_ENDS: dict[str, Callable[..., tuple[Rows, Rows]]] = {".py": parse_python}


def parse_files(files: DataFrame, rules: Iterable = ()) -> DataFrame:
    """files: file_path, text -> rows of kind node and edge (see PARSED). Files of languages without a front end give no rows."""
    from graphloom.operators import brace_languages  # noqa: F401  registers its front ends, also in the workers

    rules, front_ends = list(rules), FRONT_ENDS
    ship(files.sparkSession)

    def each(batches):
        for b in batches:
            nodes: Rows = []
            edges: Rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                front = front_ends.get("." + path.rsplit(".", 1)[-1])
                if front and text is not None:
                    n, e = front(path, text, rules)
                    nodes += n
                    edges += e
            n, e = len(nodes), len(edges)
            columns = list(zip(*nodes, strict=True)) if nodes else [[]] * len(NODE_COLUMNS)
            links = list(zip(*edges, strict=True)) if edges else [[]] * len(EDGE_COLUMNS)
            kinds = [pa.int32() if c.startswith("line_") else pa.string() for c in NODE_COLUMNS]
            arrays = [pa.array(["node"] * n + ["edge"] * e, pa.string())]
            arrays += [pa.array([*c, *[None] * e], k) for c, k in zip(columns, kinds, strict=True)]
            arrays += [pa.array([*[None] * n, *c], pa.string()) for c in links]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", *NODE_COLUMNS, *EDGE_COLUMNS])

    return files.select("file_path", "text").mapInArrow(each, PARSED)


def nodes_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'node'").select(*NODE_COLUMNS).dropDuplicates(["id"])


def edges_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'edge'").select(*EDGE_COLUMNS).distinct()
