"""Search: a small full-text language ranked by BM25, a LIKE fallback, cosine top-k, and both together.

Query language: words and "phrases" side by side mean AND; OR and NOT; word* takes longer words; title:word and keywords:word
look at one column; parentheses group. A bare word with an underscore is a phrase. What doesn't parse falls back to LIKE.

A stored graph has postings (`postings`: token, id, length, places; `lengths`: id, length), sorted by token, so a query reads its own words' rows.
Without them each text is cut into tokens once a query, and only the query's words are kept. Either way the hits are a small written
table, from which ranks and statistics are taken.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import scope_like
from graphloom.functions.text import FOLD, cosine, exact_boost, like_contains, phrase_count, tokens
from graphloom.shared import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("title", "keywords")


class QuerySyntaxError(ValueError):
    """The text is not a query of the full-text language."""


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False
    column: str | None = None


@dataclass
class Node:
    kind: str  # phrase, and, or, not
    parts: list = field(default_factory=list)
    phrase: Phrase | None = None


LEXEME = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<word>\w+)|(?P<mark>[():*+]))', re.UNICODE)


def _words(text: str) -> list[str]:
    folded = text.lower().translate(FOLD)
    return [w for w in re.split(r"[\W_]+", folded) if w]


def parse_query(text: str) -> Node:
    """The query as a tree; QuerySyntaxError if it is none."""
    items, at = [], 0
    while at < len(text.rstrip()):
        m = LEXEME.match(text, at)
        if not m:
            raise QuerySyntaxError(text)
        items.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    pos = 0

    def peek(k: int = 0):
        return items[pos + k] if pos + k < len(items) else (None, None)

    def either() -> Node:
        nonlocal pos
        parts = [both()]
        while peek() == ("word", "OR"):
            pos += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", parts)

    def both() -> Node:
        nonlocal pos
        parts = [without()]
        while True:
            if peek() == ("word", "AND"):
                pos += 1
            elif peek()[0] is None or peek() in (("word", "OR"), ("word", "NOT"), ("mark", ")")):
                break
            parts.append(without())
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def without() -> Node:
        nonlocal pos
        left = unit()
        while peek() == ("word", "NOT"):
            pos += 1
            left = Node("not", [left, unit()])
        return left

    def unit() -> Node:
        nonlocal pos
        kind, value = peek()
        column = None
        if kind == "word" and peek(1) == ("mark", ":"):
            if value.lower() not in COLUMNS:
                raise QuerySyntaxError(text)
            column, pos = value.lower(), pos + 2
            kind, value = peek()
        if kind == "mark" and value == "(" and column is None:
            pos += 1
            inner = either()
            if peek() != ("mark", ")"):
                raise QuerySyntaxError(text)
            pos += 1
            return inner
        if kind not in ("word", "quoted") or (kind == "word" and value in ("AND", "OR", "NOT")):
            raise QuerySyntaxError(text)
        pos += 1
        words = _words(value.strip('"').replace('""', " ") if kind == "quoted" else value)
        prefix = peek() == ("mark", "*")
        pos += prefix
        return Node("phrase", phrase=Phrase(words, bool(prefix), column))

    if not items:
        raise QuerySyntaxError(text)
    tree = either()
    if pos != len(items):
        raise QuerySyntaxError(text)
    return tree


def _phrases(tree: Node) -> list[Phrase]:
    return [tree.phrase] if tree.kind == "phrase" else [x for p in tree.parts for x in _phrases(p)]


def _matches(tree: Node, counts: dict[int, Column]) -> Column:
    if tree.kind == "phrase":
        return counts[id(tree.phrase)] > 0
    parts = [_matches(p, counts) for p in tree.parts]
    out = parts[0]
    for x in parts[1:]:
        out = out & x if tree.kind == "and" else out | x if tree.kind == "or" else out & ~x
    return out


MOST_SENT = 1 << 18  # hits that are sent to the nodes instead of being shuffled to them


def _cut(nodes: DataFrame) -> DataFrame:
    """id and tokens of each column. The explosion of one row keeps Spark from cutting a text once for each use of its tokens."""
    return nodes.select("id", F.explode(F.array(F.struct(*[tokens(F.col(c)).alias(c) for c in COLUMNS]))).alias("t")).select("id", *[F.col(f"t.{c}").alias(c) for c in COLUMNS])


def _length() -> Column:
    return sum((F.size(c) for c in COLUMNS[1:]), F.size(COLUMNS[0]))


def _hits(keep: Callable[[Column], Column]) -> Column:
    def of(k: int) -> Column:
        placed = F.transform(COLUMNS[k], lambda w, i: F.struct(F.lit(k).alias("c"), w.alias("w"), i.alias("i")))
        return F.filter(placed, lambda x: keep(x["w"]))

    return F.concat(*map(of, range(len(COLUMNS))))


def postings(nodes: DataFrame) -> DataFrame:
    """token, id, length of the node in tokens, then the places of the token in each column, ascending."""
    rows = _cut(nodes).select("id", _length().alias("length"), F.inline(_hits(lambda w: F.lit(True))))
    places = [F.array_sort(F.collect_list(F.when(F.col("c") == k, F.col("i")))).alias(c) for k, c in enumerate(COLUMNS)]
    return rows.groupBy(F.col("w").alias("token"), "id", "length").agg(*places)


def lengths(nodes: DataFrame) -> DataFrame:
    """id, length: number of tokens of each node."""
    return _cut(nodes).select("id", _length().alias("length"))


@dataclass
class Index:
    """Postings and lengths of a stored graph."""

    postings: DataFrame
    lengths: DataFrame

    def hits(self, words: list[tuple[str, bool]]) -> DataFrame:
        """id, length, hits of the nodes that hold one of the words (word, prefix)."""
        wanted = F.lit(False)
        for w, prefix in words:
            wanted = wanted | (((F.col("token") >= w) & (F.col("token") < w + "\U0010ffff")) if prefix else (F.col("token") == w))
        found = self.postings.where(wanted)

        def of(k: int) -> Column:
            return F.transform(COLUMNS[k], lambda i: F.struct(F.lit(k).alias("c"), F.col("token").alias("w"), i.alias("i")))

        return found.groupBy("id", "length").agg(F.flatten(F.collect_list(F.concat(*map(of, range(len(COLUMNS)))))).alias("hits"))

    def totals(self) -> DataFrame:
        return self.lengths.agg(F.count(F.lit(1)).alias("_n"), F.avg("length").alias("_avg"))


def _counted(nodes: DataFrame, wanted: list[Phrase], index: Index | None) -> tuple[DataFrame, DataFrame]:
    """Written counts of the phrases in each node that may hold one (id, _dl, _f0 ...), and one row of statistics over all nodes."""
    spark = nodes.sparkSession
    words = sorted({(w, ph.prefix and k == len(ph.words) - 1) for ph in wanted for k, w in enumerate(ph.words)})

    def keep(w: Column) -> Column:
        out = w.isin([x for x, prefix in words if not prefix])
        for x, prefix in words:
            out = out | w.startswith(x) if prefix else out
        return out

    counts = [phrase_count(F.col("hits"), ph.words, ph.prefix, None if ph.column is None else COLUMNS.index(ph.column)) if ph.words else F.lit(0) for ph in wanted]
    if index is None:
        found = _cut(nodes).select("id", _length().alias("length"), _hits(keep).alias("hits"))
    else:
        found = index.hits(words)
    counted = found.select("id", F.col("length").cast("double").alias("_dl"), *[c.cast("double").alias(f"_f{k}") for k, c in enumerate(counts)])
    counted = written(spark, counted, "search-hits")
    of = [F.count_if(F.col(f"_f{k}") > 0).alias(f"_n{k}") for k in range(len(wanted))]
    if index is None:
        return counted, counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), *of)
    return counted, counted.agg(*of).join(index.totals(), F.lit(True))  # one row each


def full_text(nodes: DataFrame, query: str, index: Index | None = None) -> DataFrame:
    """nodes that match, with `rank_score` (BM25, higher is better). Statistics are over all nodes, in one aggregate row."""
    tree = parse_query(query)
    wanted = _phrases(tree)
    counted, stats = _counted(nodes, wanted, index)
    s = stats.head()
    flags = {id(ph): F.col(f"_f{k}") for k, ph in enumerate(wanted)}
    score = F.lit(0.0)
    for k in range(len(wanted)):
        n, own = s["_n"], s[f"_n{k}"] or 0
        idf = math.log((n - own + 0.5) / (own + 0.5))
        f = F.col(f"_f{k}")
        score = score + F.lit(idf if idf > 0 else LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.lit(s["_avg"] or 1.0)))
    best = counted.where(_matches(tree, flags)).select(F.col("id").alias("_id"), score.alias("rank_score"))
    if best.count() <= MOST_SENT:
        best = F.broadcast(best)
    return nodes.join(best, F.col("id") == F.col("_id")).select(*nodes.columns, "rank_score")


def _found(nodes: DataFrame, query: str, index: Index | None) -> DataFrame:
    """Nodes that match, with `rank_score`; a query that doesn't parse is looked for in titles by LIKE, with rank 0."""
    try:
        return full_text(nodes, query, index)
    except QuerySyntaxError:
        return nodes.where(like_contains(F.col("title"), query)).withColumn("rank_score", F.lit(0.0))


def search_nodes(nodes: DataFrame, query: str, limit: int = 20, scope: str | None = None, index: Index | None = None) -> DataFrame:
    """The best `limit` nodes, in scope if one is given. Ranks are over the whole graph; ties go by id."""
    found = _found(nodes, query, index)
    return (found if scope is None else found.where(scope_like(F.col("file_path"), scope))).orderBy(F.desc("rank_score"), "id").limit(limit)


def search_entry_points(nodes: DataFrame, query: str, limit: int = 20, scope: str | None = None, index: Index | None = None) -> DataFrame:
    """Results in scope; if there are none, those of the whole graph. What matches is worked out once: the best of both kinds are
    taken side by side, and one row tells whether there are any in scope."""
    if scope is None:
        return search_nodes(nodes, query, limit, index=index)
    order = [F.desc("rank_score"), "id"]
    found = _found(nodes, query, index).withColumn("_in", F.coalesce(scope_like(F.col("file_path"), scope), F.lit(False)))
    best = found.orderBy(F.desc("_in"), *order).limit(limit).withColumn("_any", F.max("_in").over(Window.partitionBy()))  # `limit` rows
    every = found.orderBy(*order).limit(limit)
    inner = best.where("_in").drop("_any")
    return inner.unionByName(every.join(best.where("_any").limit(1).select(F.lit(1).alias("_one")), F.lit(True), "left_anti")).drop("_in").orderBy(*order)


def search_semantic(nodes: DataFrame, embeddings: DataFrame, vector: list[float], limit: int = 10, scope: str | None = None) -> DataFrame:
    """The nearest nodes by cosine, as `score`. Vectors of another length than the query's are passed over; ids without a node
    are left out after the best are chosen, as ranks are over vectors."""
    table = embeddings.where(F.size("vector") == len(vector))
    if scope is not None:
        table = table.join(nodes.where(scope_like(F.col("file_path"), scope)).select(F.col("id").alias("node_id")), "node_id", "left_semi")
    best = table.select("node_id", cosine(F.col("vector"), vector).alias("score")).orderBy(F.desc("score"), F.desc("node_id")).limit(limit)
    return nodes.join(F.broadcast(best), F.col("id") == F.col("node_id")).drop("node_id").orderBy(F.desc("score"), F.desc("id"))  # best has `limit` rows


def search_hybrid(nodes: DataFrame, query: str, embeddings: DataFrame | None = None, vector: list[float] | None = None, limit: int = 10, scope: str | None = None, index: Index | None = None) -> DataFrame:
    """Full-text hits at 1.0, then semantic ones that are no hits, each with the boost of a close name, up to 1.0."""
    hits = search_entry_points(nodes, query, limit, scope, index).withColumn("score", F.lit(1.0)).withColumn("pass", F.lit(0))
    found = hits
    if embeddings is not None and vector is not None:
        near = search_semantic(nodes, embeddings, vector, limit, scope).join(hits.select("id"), "id", "left_anti")
        found = hits.unionByName(near.withColumn("rank_score", F.lit(0.0)).withColumn("pass", F.lit(1)))
    boosted = found.withColumn("raw", F.col("score")).withColumn("score", F.least(F.lit(1.0), F.col("score") + exact_boost(query, F.col("name"), F.col("title"))))
    return boosted.orderBy(F.desc("score"), "pass", F.desc("rank_score"), F.desc("raw"), "id").limit(limit)


def exact_name_first(found: DataFrame, name: str) -> DataFrame:
    """One row: the first result named so, else the first result. found: a result of search_hybrid or search_nodes."""
    score = "score" if "score" in found.columns else "rank_score"
    return found.orderBy((F.col("name") == name).desc(), F.desc(score), "id").limit(1)
