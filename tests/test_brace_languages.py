"""Front ends of other languages on small sources."""

from __future__ import annotations

from graphloom.operators import brace_languages, parse

JS = """// import no from 'x'
import { a,
  b } from "./m";
import React from 'react'

export function outer(x, y = f(1)) {
  const s = "call(me)";
  inner(x);
  list.map((z) => { hidden(z); });
  return obj.deep.go(y);
}

class Box extends Base {
  constructor(n) { super(n); this.n = make(n); }
  async size() { return count(this.n) }
}

top_level();
"""
GO = """package main

import (
	"fmt"
)

type T struct { a int }

func (t *T) Name(x int) string {
	return fmt.Sprint(helper(x))
}

func main() { run() }
"""
RUST = """use std::fmt::{self, Display};

pub struct P { x: i32 }

impl P {
    pub fn new(x: i32) -> Self { build(x) }
}

fn main() {
    let v = items.iter().map(|i| secret(i));
    println!("no {}", p.show());
}
"""


def read(path: str, source: str):
    nodes, edges = parse.FRONT_ENDS["." + path.rsplit(".", 1)[1]](path, source)
    name = {n[0]: n[2] for n in nodes}
    return {(n[1], n[2]): n for n in nodes if n[4] == path}, {(name[a], name[b], k) for a, b, k in edges}


def test_javascript():
    nodes, edges = read("src/app.tsx", JS)
    assert nodes["function", "outer"][3] == "src.app.outer" and nodes["function", "outer"][5:8] == (6, 11, "(x, y = f(1))")
    assert nodes["method", "size"][3] == "src.app.Box.size" and nodes["class", "Box"][5:7] == (13, 16)
    assert nodes["import", 'import { a,\n  b } from "./m";'][5:7] == (2, 3) and ("import", "import React from 'react'") in nodes
    assert {("outer", "inner", "calls"), ("outer", "go", "calls"), ("constructor", "make", "calls"), ("size", "count", "calls"), ("Box", "size", "contains"), ("src.app", "Box", "defines"), ("src.app", "outer", "defines")} <= edges
    assert not {b for _, b, k in edges if k == "calls"} & {"hidden", "me", "top_level", "super"}


def test_go():
    nodes, edges = read("main.go", GO)
    assert {k for k in nodes if k[0] == "function"} == {("function", "Name"), ("function", "main")} and not [k for k in nodes if k[0] == "class"]
    assert {("Name", "Sprint", "calls"), ("Name", "helper", "calls"), ("main", "run", "calls")} <= edges and len([1 for k in nodes if k[0] == "import"]) == 1


def test_rust():
    nodes, edges = read("lib.rs", RUST)
    assert ("method", "new") in nodes and ("class", "P") in nodes and ("import", "use std::fmt::{self, Display};") in nodes
    assert {("new", "build", "calls"), ("main", "iter", "calls"), ("main", "show", "calls")} <= edges
    assert "secret" not in {b for _, b, _ in edges}


def test_nothing_makes_it_fail():
    for s in ("", "{", "}}}", "function (", "class", "fn x(", "import {", "'", '"', "/*", "a => ", "impl {", "func ("):
        for language in (brace_languages.SCRIPT, brace_languages.GO, brace_languages.RUST):
            assert brace_languages.parse_braces("x.js", s, language)[0]


def test_jsx_rule():
    class Elements:
        handled_names = ()

        def handle_jsx_element(self, name, caller, out):
            out.edge(caller, out.stub("function", name), "renders")

    _, edges = brace_languages.parse_braces("a.jsx", "function Page() { return <Card a={1}/>; }", brace_languages.SCRIPT, [Elements()])
    assert [k for _, _, k in edges if k == "renders"] == ["renders"]
