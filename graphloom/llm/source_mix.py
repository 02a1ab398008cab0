"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Weights are levelled to targets: a source may be taken `most_passes` times, and what lies above is shared among the others
by weight until no target is above its limit. Equal blocks of words go to the sources by highest quotients
target / (2 k - 1); each source's blocks go in the same way to its shards (hash groups of its documents), which gives an
integer quota per shard. Inside a shard the documents stand in a seeded order and the quota is taken from its start, over
again when it is longer than the shard; a document at the end of a quota is taken in part.

Only the words of a document are counted from its text; that is one pass. The counts are a written table, so later steps
read numbers. Sources with a third of all rows have a third of all shards, so no task holds a source.

Null and empty texts have size 0 and are taken 0 times. Null is a source of its own and comes last. Repeated rows are rows
of their own. An empty table gives no rows. A source without words has target 0. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import fresh, written

WORD_GAPS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Params:
    weights: tuple[float, ...] = (5, 2, 1)  # by the rank of a source, over again
    share: float = 1.5  # of all words
    most_passes: int = 2
    block_words: int = 64
    shard_docs: int = 256  # documents of a shard, about
    most_shards: int = 4096  # of a source; beyond, shards grow
    seed: str = "mix-1"
    most_cuts: int = 1 << 18  # shards whose cut-offs the stage sends to all executors


def n_words(text: Column) -> Column:
    """Number of runs of other characters than space and tab to carriage return."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, WORD_GAPS))).otherwise(0).cast("long")


def targets(per_source: DataFrame, p: Params) -> DataFrame:
    """source, source_size, docs -> the same with `weight` and `target`. One row a source.

    The level L at which sum(least(limit, L * weight)) is the wanted total is found from running sums over the sources by
    limit / weight: the first k are at their limit if the k + 1-th isn't at the level that they leave.
    """
    ranked = per_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weights = F.array(*[F.lit(float(w)) for w in p.weights])
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("rank") % len(p.weights) + 1).cast("int"))).withColumn("limit", p.most_passes * F.col("source_size"))
    every, before = Window.partitionBy(), Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "wanted": F.least(p.share * F.sum("source_size").over(every), F.sum("limit").over(every).cast("double")),
        "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "taken_before": F.coalesce(F.sum("limit").over(before), F.lit(0)),
    })
    ranked = ranked.withColumn("level", (F.col("wanted") - F.col("taken_before")) / F.col("left_weight"))
    # the first source that its level leaves below its limit sets the level of all
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(every)["level"]
    ranked = ranked.withColumn("own_level", level)
    return ranked.withColumn("target", F.coalesce(F.least(F.col("limit").cast("double"), F.col("own_level") * F.col("weight")), F.col("limit").cast("double"))).select("source", "source_size", "docs", "weight", "target")


def sainte_lague(df: DataFrame, votes: str, seats: Column, by: list[str], order: list[str], out: str) -> DataFrame:
    """Apportions `seats` (equal in all rows of a group `by`) to rows by the highest quotients votes / (2 k - 1).

    Divisors that surely give too few and too many seats bound each row's seats from both sides; together the bounds leave a
    few open seats a row, and only these are ranked. Ties go by `order`.
    """
    group = Window.partitionBy(*by)
    open_ = df.withColumns({"_seats": seats, "_all": F.sum(votes).over(group), "_n": F.count(F.lit(1)).over(group)})
    few, many = F.col("_all") / (F.col("_seats") - F.col("_n") / 2), F.col("_all") / (F.col("_seats") + F.col("_n") / 2)
    at = lambda d: F.floor(F.col(votes) / d + 0.5)
    low = F.when((F.col("_seats") * 2 > F.col("_n")) & (F.col("_all") > 0), F.greatest(at(few) - 1, F.lit(0))).otherwise(0).cast("long")
    high = F.when(F.col("_all") > 0, at(many) + 1).otherwise(0).cast("long")
    open_ = open_.withColumn("_low", low).withColumn("_k", F.explode_outer(F.when(high > low, F.sequence(low + 1, high))))
    # sum of sure seats: each row counts once, at its first open seat or its only row
    once = F.when(F.col("_k").isNull() | (F.col("_k") == F.col("_low") + 1), F.col("_low")).otherwise(0)
    ranked = open_.withColumn("_sure", F.sum(once).over(group)).withColumn("_r", F.row_number().over(group.orderBy((F.col(votes) / (2 * F.col("_k") - 1)).desc_nulls_last(), *order)))
    won = F.max(F.when(F.col("_k").isNotNull() & (F.col("_r") <= F.col("_seats") - F.col("_sure")), F.col("_k")))
    return ranked.groupBy(*df.columns).agg(F.greatest(F.coalesce(won, F.lit(0)), F.max("_low")).alias(out))


def _shard(h: Column, shards: Column) -> Column:
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), shards)


def _place(p: Params) -> Column:
    """What orders a row in its shard. Rows without an id go by their text, so that no shard gathers them."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return F.md5(F.concat_ws("|", F.lit(p.seed), who, F.col("source")))


@dataclass
class Plan:
    """sizes: doc_id, source, size, h of each row; sources: source, source_size, target, blocks, shards; quotas: source, shard,
    shard_size, passes (words taken of the shard). All written tables."""

    sizes: DataFrame
    sources: DataFrame
    quotas: DataFrame


def plan(spark: SparkSession, docs: DataFrame, p: Params = Params()) -> Plan:
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _place(p).alias("h"))
    sizes = written(spark, sizes, "mix-sizes")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    aimed = targets(per_source, p).withColumn("_one", F.lit(1))
    total = F.round(F.sum("target").over(Window.partitionBy("_one")) / p.block_words)
    given = sainte_lague(aimed.withColumn("blocks_all", total), "target", F.col("blocks_all"), ["_one"], ["source"], "blocks")
    shards = F.least(F.ceil(F.col("docs") / p.shard_docs), F.lit(p.most_shards)).cast("long")
    given = written(spark, given.select("source", "source_size", "target", "blocks", shards.alias("shards")), "mix-sources")  # small as read: the planner may send it to all
    per_shard = sizes.join(given, sizes["source"].eqNullSafe(given["source"])).groupBy(sizes["source"], _shard(F.col("h"), F.col("shards")).alias("shard"), "blocks").agg(F.sum("size").alias("shard_size"))
    quota = sainte_lague(per_shard, "shard_size", F.col("blocks"), ["source"], ["shard"], "quota")
    passes = F.least(F.col("quota") * p.block_words, p.most_passes * F.col("shard_size"))
    return Plan(sizes, given, written(spark, quota.select("source", "shard", "shard_size", passes.alias("passes")), "mix-quotas"))


def _placed(made: Plan) -> DataFrame:
    """Each row's numbers beside its shard's."""
    q = made.quotas.select(F.col("source").alias("_s"), F.col("shard").alias("_k"), "shard_size", "passes")
    s = made.sources
    placed = made.sizes.join(s, made.sizes["source"].eqNullSafe(s["source"])).select("doc_id", made.sizes["source"], "size", "h", "source_size", "target", _shard(F.col("h"), F.col("shards")).alias("shard"))
    return placed.join(q, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_k"))).drop("_s", "_k")


def _passes() -> tuple[Column, Column]:
    """Whole passes over a shard, and what is left of its quota for one more, from the shard's start."""
    whole = F.when(F.col("shard_size") > 0, F.floor(F.col("passes") / F.col("shard_size"))).otherwise(0)
    return whole, F.col("passes") - whole * F.col("shard_size")


def mix(spark: SparkSession, docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each row of docs."""
    row = _placed(plan(spark, docs, p))
    seeded = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = row.withColumn("first", F.sum("size").over(seeded) - F.col("size"))
    whole, rest = _passes()
    taken = whole * F.col("size") + F.least(F.col("size"), F.greatest(rest - F.col("first"), F.lit(0)))
    return row.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def cuts(made: Plan) -> DataFrame:
    """source, shard, shards, whole, last: of each shard, how often all of it is taken, and the (h, size) up to which documents are taken
    once more. A document at the end of the quota is taken if half of it or more is; rows of one (h, size) share evenly."""
    seeded = Window.partitionBy("source", "shard").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alike = _placed(made).where("size > 0").groupBy("source", "shard", "h", "size", "shard_size", "passes").agg(F.sum("size").alias("words"))
    whole, rest = _passes()
    got = rest - (F.sum("words").over(seeded) - F.col("words"))
    alike = alike.withColumns({"whole": whole, "extra": 2 * got >= F.col("words")})
    ends = alike.groupBy("source", "shard").agg(F.first("whole").alias("whole"), F.max(F.when(F.col("extra"), F.struct("h", "size"))).alias("last"))
    s = made.sources.select(F.col("source").alias("_s"), "shards")
    return ends.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def stage(spark: SparkSession, docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents of the mix, with their own columns: as often as they are taken whole, and once more if what is left of
    their share is half of them or more. A document without words is not taken.

    Inside a shard documents stand in a seeded order, so one cut-off a shard tells what is taken, and each row finds its copies by
    its own place. The cut-offs are a row a shard (`shard_docs` documents, `most_shards` a source at most); they are sent to all
    while they are at most `most_cuts`, else joined, so no row of the documents meets another one.
    """
    found = written(spark, cuts(plan(spark, docs, p)), "mix-cuts")
    source, shard, shards, whole, last, size, h, copy = fresh(docs, 8)
    found = found.select(*(F.col(a).alias(b) for a, b in (("source", source), ("shard", shard), ("shards", shards), ("whole", whole), ("last", last))))
    per_source = found.select(source, shards).distinct()
    if found.count() <= p.most_cuts:  # some 80 bytes a row
        found, per_source = F.broadcast(found.drop(shards)), F.broadcast(per_source)
    else:
        found = found.drop(shards)
    sized = docs.withColumns({size: n_words(F.col("text")), h: _place(p)})
    placed = sized.join(per_source, F.col("source").eqNullSafe(F.col(source))).drop(source)
    met = placed.join(found, F.col("source").eqNullSafe(F.col(source)) & (_shard(F.col(h), F.col(shards)) == F.col(shard)))
    more = F.coalesce(F.struct(F.col(h).alias("h"), F.col(size).alias("size")) <= F.col(last), F.lit(False))
    copies = F.col(whole).cast("int") + more.cast("int")
    return met.withColumn(copy, F.explode(F.when((F.col(size) > 0) & (copies > 0), F.sequence(F.lit(1), copies)))).select(*docs.columns)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(spark, docs)


def oracle(p: Params = Params()) -> str:
    """The same rows with every quotient ranked."""
    weights = ", ".join(str(float(w)) for w in p.weights)
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def seats(name: str, rows: str, votes: str, total: str, by: str, order: str) -> str:
        return f"""{name}_n AS (SELECT *, sum({votes}) OVER (PARTITION BY {by}) AS all_votes, count(*) OVER (PARTITION BY {by}) AS n FROM {rows}),
{name}_k AS (SELECT *, unnest(range(1, CASE WHEN all_votes > 0 THEN CAST(floor({votes} * ({total} + n / 2.0) / all_votes + 0.5) AS BIGINT) + 3 ELSE 1 END)) AS k FROM {name}_n),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {votes} / (2 * k - 1) DESC, {order} NULLS FIRST) AS r FROM {name}_k)"""

    return f"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws('|', '{p.seed}', coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))), source)) AS h FROM documents),
ps AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM s GROUP BY source),
pw AS (SELECT *, [{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(p.weights)} + 1] AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank, {p.most_passes} * source_size AS cap FROM ps),
pl AS (SELECT *, least({p.share} * sum(source_size) OVER (), sum(cap) OVER ()) AS wanted, sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank {before}), 0) AS left_weight, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank {before}), 0) AS taken_before FROM pw),
lv AS (SELECT (wanted - taken_before) / left_weight AS level FROM pl WHERE (wanted - taken_before) / left_weight * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT source, source_size, docs, CAST(coalesce(least(cap, (SELECT level FROM lv) * weight), cap) AS DOUBLE) AS target, 1 AS one FROM pl),
tb AS (SELECT *, CAST(round(sum(target) OVER () / {p.block_words}) AS BIGINT) AS blocks_all FROM t),
{seats('a', 'tb', 'target', 'blocks_all', 'one', 'source')},
g AS (SELECT t.*, least(CAST(ceil(docs / {float(p.shard_docs)}) AS BIGINT), {p.most_shards}) AS shards, coalesce((SELECT count(*) FROM a_r WHERE a_r.source IS NOT DISTINCT FROM t.source AND r <= blocks_all), 0) AS blocks FROM t),
d AS (SELECT s.*, source_size, target, blocks, CAST('0x' || substr(h, 1, 8) AS BIGINT) % shards AS shard FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
sh AS (SELECT coalesce(source, '') AS name, source IS NULL AS none, shard, blocks, sum(size) AS shard_size FROM d GROUP BY ALL),
{seats('b', 'sh', 'shard_size', 'blocks', 'name, none', 'shard')},
q AS (SELECT name, none, shard, count(*) FILTER (r <= blocks) * {p.block_words} AS quota FROM b_r GROUP BY ALL),
c AS (SELECT d.*, sh.shard_size, coalesce(q.quota, 0) AS quota, sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS first
 FROM d JOIN sh ON sh.name = coalesce(d.source, '') AND sh.none = (d.source IS NULL) AND sh.shard = d.shard LEFT JOIN q ON q.name = sh.name AND q.none = sh.none AND q.shard = sh.shard),
e AS (SELECT *, least(quota, {p.most_passes} * shard_size) AS passes FROM c),
f AS (SELECT *, CASE WHEN shard_size > 0 THEN passes // shard_size ELSE 0 END AS whole FROM e)
SELECT doc_id, source, size, source_size, target, CAST(whole * size + least(size, greatest(passes - whole * shard_size - first, 0)) AS BIGINT) AS taken FROM f"""
