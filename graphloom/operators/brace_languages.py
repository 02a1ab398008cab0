"""Front ends for JavaScript, TypeScript, Go and Rust, by one scan over tokens and braces instead of a grammar.

Comments and strings are blanked first, so offsets and lines stay. The scan keeps a stack of what each brace opens: a function, a
class, a closure or something else. What is found: named functions and methods with their parameter lists, classes (interfaces,
structs, enums, traits), import statements as their text, and calls by the last name before the parenthesis. A function whose
nearest function or class around it is a class (in Rust also an impl block) is a method. Calls belong to the nearest function;
inside arrow functions and closures, and outside of functions, they are none. Variables, references and inheritance are read from
Python sources only. A scan knows no types and no macros, so odd layouts may be missed; nothing it reads can make it fail.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from graphloom.operators.parse import FRONT_ENDS, Collector, Rows, module_name


@dataclass(frozen=True)
class Language:
    function: str  # pattern of a named function's head; group name
    classes: str  # pattern of a class's head; group name
    imports: str  # pattern of an import's first word at the start of a line
    arrows: str  # what opens a function without a name whose calls count for nobody
    methods: bool  # whether a class body holds functions without a keyword
    unnamed: str = ""  # pattern of a head that makes functions inside methods, without a class node
    backquote: bool = True


SCRIPT = Language(r"\bfunction\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)", r"\b(?:class|interface)\s+(?P<name>[A-Za-z_$][\w$]*)", r"import\b(?!\s*\()", r"=>", True)
GO = Language(r"\bfunc\s*(?:\([^()]*\)\s*)?(?P<name>[A-Za-z_]\w*)", r"(?!)(?P<name>)", r"import\b", r"(?!)", False)
RUST = Language(r"\bfn\s+(?P<name>[A-Za-z_]\w*)", r"\b(?:struct|enum|trait)\s+(?P<name>[A-Za-z_]\w*)", r"(?:pub(?:\([^)]*\))?\s+)?use\b", r"(?<=[(,={])\s*(?:move\s*)?\|[^|\n]*\|", False, r"\bimpl\b", False)

#: Words before a parenthesis that call nothing.
NO_CALL = frozenset("if for while switch catch return function func fn match loop with typeof await new in of else do defer select super import".split())


def blanked(source: str, language: Language) -> str:
    """The source with comments and the insides of strings as spaces; lines stay."""
    quotes = r'"(?:\\.|[^"\\\n])*"'
    quotes += r"|'(?:\\.|[^'\\\n])'" if language is RUST else r"|'(?:\\.|[^'\\\n])*'"
    quotes += r"|`(?:\\.|[^`\\])*`" if language.backquote else ""
    return re.sub(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|{quotes}", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.DOTALL)


def _closing(text: str, at: int, pair: str = "()") -> int:
    """Index behind the bracket that closes the one at `at`; the end of the text if none does."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == pair[0]) - (text[i] == pair[1])
        if depth == 0:
            return i + 1
    return len(text)


def _import_end(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] in "({") - (text[i] in ")}")
        if depth <= 0 and (text[i] == ";" or text[i] == "\n"):
            return i + (text[i] == ";")
    return len(text)


def _expression_end(text: str, at: int) -> int:
    """End of an expression that starts at `at`: where its brackets close more than they open, or a comma, semicolon or line ends it."""
    depth = 0
    for i in range(at, len(text)):
        c = text[i]
        depth += (c in "([{") - (c in ")]}")
        if depth < 0 or (depth == 0 and c in ",;\n" and i > at):
            return i
    return len(text)


def parse_braces(path: str, source: str, language: Language, rules: Iterable = ()) -> tuple[Rows, Rows]:
    out = Collector(path)
    text = blanked(source, language)
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    line = lambda i: _lines_before(breaks, i) + 1
    name = module_name(path)
    module = out.node("module", name, name, 1, max(1, source.count("\n") + (not source.endswith("\n"))))
    by_name = {n: r for r in rules for n in r.handled_names}
    for m in re.finditer(rf"(?m)^[ \t]*(?P<head>{language.imports})", text):
        end = _import_end(text, m.end())
        said = source[m.start("head") : end].strip()
        out.edge(module, out.node("import", said, said, line(m.start("head")), line(max(m.start("head"), end - 1))), "imports")

    # bodies: (open brace, end, kind, name, head)
    bodies: list[tuple[int, int, str, str, int, str]] = []
    for m in re.finditer(language.classes, text):
        at = re.compile(r"[{;]").search(text, m.end())
        opened = at is not None and text[at.start()] == "{"
        bodies.append((at.start() if at else m.end(), _closing(text, at.start(), "{}") if opened else (at.end() if at else m.end()), "class", m["name"], m.start(), ""))
    if language.unnamed:
        for m in re.finditer(language.unnamed, text):
            at = text.find("{", m.end())
            if at >= 0:
                bodies.append((at, _closing(text, at, "{}"), "unnamed", "", m.start(), ""))
    heads = [(m["name"], m.start(), m.end()) for m in re.finditer(language.function, text)]
    if language.methods:
        inside = [(b[0], b[1]) for b in bodies if b[2] == "class"]
        for lo, hi in inside:
            i = lo + 1
            while i < hi - 1:
                if text[i] == "{":
                    i = _closing(text, i, "{}")
                    continue
                m = re.compile(r"[A-Za-z_$#][\w$]*").match(text, i)
                if not m:
                    i += 1
                    continue
                rest = re.compile(r"\s*(?:<[^>]*>)?\s*\(").match(text, m.end())
                if rest and m[0] not in NO_CALL:
                    heads.append((m[0], m.start(), m.end()))
                    i = _closing(text, rest.end() - 1)
                else:
                    i = m.end()
    declared = set()
    for fname, start, end in heads:
        paren = text.find("(", end)
        if paren < 0:
            continue
        after = _closing(text, paren)
        brace = re.compile(r"[{;]").search(text, after)
        if brace is None or text[brace.start()] != "{":
            continue
        declared.add(end - len(fname))
        bodies.append((brace.start(), _closing(text, brace.start(), "{}"), "function", fname, start, source[paren:after]))
    for m in re.finditer(language.arrows, text):
        at = re.compile(r"\s*").match(text, m.end()).end()
        end = _closing(text, at, "{}") if text[at : at + 1] == "{" else _expression_end(text, at)
        bodies.append((m.end(), end, "arrow", "", m.start(), ""))

    bodies.sort(key=lambda b: (b[4], -b[1]))
    stack: list[tuple[int, str, str, list[str]]] = []  # end, kind, node id, scope
    owners: list[tuple[int, int, str, str]] = []
    for lo, hi, kind, bname, head, signature in bodies:
        while stack and stack[-1][0] <= head:
            stack.pop()
        scope = next((s[3] for s in reversed(stack) if s[3]), [name])
        node = ""
        if kind == "class":
            node = out.node("class", bname, ".".join([*scope, bname]), line(head), line(hi - 1))
            out.edge(module, node, "defines")
        elif kind == "function":
            near = next((s[1] for s in reversed(stack)), "")
            method = near in ("class", "unnamed")
            node = out.node("method" if method else "function", bname, ".".join([*scope, bname]), line(head), line(hi - 1), signature)
            out.edge(next((s[2] for s in reversed(stack) if s[2]), module), node, "contains" if method else "defines")
        stack.append((hi, kind, node, [*scope, bname] if bname else []))
        if kind in ("function", "arrow"):
            owners.append((lo, hi, kind, node))

    for m in re.finditer(r"(?<![\w$])(?P<name>[A-Za-z_$][\w$]*)\s*\(", text):
        if m["name"] in NO_CALL or m.start() in declared:
            continue
        around = [o for o in owners if o[0] < m.start() < o[1]]
        owner = max(around, key=lambda o: o[0]) if around else None
        caller = owner[3] if owner and owner[2] == "function" else ""
        rule = by_name.get(m["name"])
        if rule is not None:
            rule.handle_call(m["name"], source[m.start() : _closing(text, m.end() - 1)], caller or module, out)
        elif caller:
            out.edge(caller, out.stub("function", m["name"]), "calls")
    elements = [r for r in rules if hasattr(r, "handle_jsx_element")]
    if language is SCRIPT and elements:
        for m in re.finditer(r"<(?P<name>[A-Z][\w$.]*)(?=[\s/>])", text):
            around = [o for o in owners if o[0] < m.start() < o[1] and o[2] == "function"]
            for r in elements:
                r.handle_jsx_element(m["name"], max(around, key=lambda o: o[0])[3] if around else module, out)
    return list(out.nodes.values()), list(out.edges)


def _lines_before(breaks: list[int], i: int) -> int:
    lo, hi = 0, len(breaks)
    while lo < hi:
        mid = (lo + hi) // 2
        if breaks[mid] < i:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _front(language: Language):
    return lambda path, source, rules=(): parse_braces(path, source, language, rules)


for _suffix in (".js", ".jsx", ".mjs", ".ts", ".tsx"):
    FRONT_ENDS[_suffix] = _front(SCRIPT)
FRONT_ENDS[".go"] = _front(GO)
FRONT_ENDS[".rs"] = _front(RUST)
