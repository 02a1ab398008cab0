"""N-gram Jaccard join: T-occurrence search over inverted lists of word shingles, exact, with DivideSkip's split of lists.

Documents with equal shingle sets are one class; classes are joined, never copies. Shingles are ordered by how many classes
hold them, rarest first. Two sets that reach the threshold share a shingle of their first n - ceil(t n) + 1 (the T-occurrence
bound when the ceil(t n) - 1 longest lists are set aside), so only these are put into lists. At the first shingle that two sets share
all of their overlap is still ahead: a pair counts at a shingle only if both sets have as many shingles left there as the overlap that
the pair needs. So documents that share a common passage and have too much else meet at no shingle of that passage.

- Short lists are merged: each pair in one is a candidate once its lengths allow it.
- Longer lists are not merged, as their pairs grow with the square. Each is first probed around one member, the one that
  stands in most lists; once components are known, members outside of a list's largest component are probed against all of it: `probed`
  looks up, in the list sorted by size, those whose size allows the threshold, and goes by whole arrays. Very long lists are dealt to several tasks.
- Candidates lose most strangers to a bound on the symmetric difference: the parities of hash buckets (1,024 bits, two bits a
  shingle in larger sets) cannot differ in more places than the sets do.
- What is left is counted exactly on whole sets by `divide_skip`: the candidates of a class are a block with inverted lists of their
  own, of which the short ones are merged and the long ones probed by binary search; who reaches the required overlap is linked.
  First comes, for each class, the partner that shares most lists; then only pairs between different components. Pairs inside a
  component change no result and are not counted.

Which lists are long comes from counts over all documents: each task counts its classes' shingles in a fixed number of cells
and reports those above a small share of its classes; at most `most_long` of the largest sums are known to all tasks (a bounded table). The order
changes the work, never the result.

Null and empty texts, and those without words, have no shingle and are linked with nothing. Fewer than five words are one
shingle. Repeated rows are rows of their own with equal results. Rows with a null doc_id take part; the component id is the
smallest non-null doc_id. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.bytewords import distinct, shingle_sets
from graphloom.llm.common import bounded_batches, fresh, in_pieces, numbers, partitions, released, runs, sieve, sieve_bits, task, trim, written
from graphloom.llm.components import components


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80
    long_list: int = 4  # a list with more members is probed, not merged
    local_least: int = 4  # a task reports shingles that so many of its classes hold
    local_share: float = 0.0005
    most_long: int = 1 << 18


LEAST_BITS = 1024  # of the parity sketch
CELLS = 1 << 22  # of a task's counts
BLOCK = 4096  # members of a long list that one task asks for
ROWS, PAIRS, LONGS = 1 << 14, 1 << 18, 1 << 19  # members, pairs and words of sketches that are held at once
ENTRIES = 1 << 19  # that a task holds before it deals them out, so that buckets, which grow with the input, don't make rows of a few each
MU = 0.5  # weight of a long list's probe against a merged entry
STEPS = (7919, 104729)  # of the two bits of a document in the sieve
ENTRY = np.dtype([("shingle", "<u8"), ("class", "<i8"), ("n", "<u4")])
EARLY = np.uint32(1 << 31)  # of n in an entry: its shingle is among the first that a pair of equal sets may meet at


def class_of(s: np.ndarray) -> int:
    """A set's class: 64 bits of a cryptographic hash of its sorted shingles."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parity(s: np.ndarray) -> np.ndarray:
    """Whether each bucket of shingles by their low bits holds an odd number of them."""
    size = max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else LEAST_BITS
    bits = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def least_overlap(p: Params, both: Column) -> Column:
    """Smallest overlap o with 100 o >= percent (a + b - o), from a + b."""
    return F.ceil(p.percent * both / (100.0 + p.percent) - 1e-9)


def _needed(p: Params, both: np.ndarray) -> np.ndarray:
    """The same in integers."""
    return -(-p.percent * both // (100 + p.percent))


def _ahead(p: Params, n: str, pos: str, m: str, other: str) -> Column:
    """Whether sets of n and m shingles have enough left at places pos and other."""
    return F.least(F.col(n) - F.col(pos), F.col(m) - F.col(other)) >= least_overlap(p, F.col(n) + F.col(m))


def classes(spark: SparkSession, docs: DataFrame, p: Params) -> DataFrame:
    """Written rows of two kinds: a document (doc_id, n, class, parity) and a shingle's count in a task (class, n)."""
    bounded_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]

    @task("near_duplicates")
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        cells, total = np.zeros(CELLS, np.uint16), 0
        held: list[np.ndarray] = []

        for b in batches:
            n, cls, par = [], [], []
            for s in shingle_sets(b.column(1), p.words):
                n.append(len(s))
                cls.append(class_of(s))
                par.append(_parity(s))
                if len(s) and cls[-1] not in seen:
                    seen.add(cls[-1])
                    at = (s >> np.uint64(30)).astype(np.int64) & (CELLS - 1)
                    often = cells[at] >= p.local_least - 1
                    cells[at] += cells[at] < 65535
                    total += len(s)
                    if often.any():
                        held.append(s[often])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(n)), pa.int32()), b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, par)]), pa.int32()), pa.array(np.concatenate(par) if par else np.zeros(0, np.int64)))],
                names=["kind", "doc_id", "n", "class", "parity"],
            )
            if sum(map(len, held)) > 1 << 18:
                held = [distinct(np.concatenate(held))]
        v = distinct(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        c = cells[(v >> np.uint64(30)).astype(np.int64) & (CELLS - 1)].astype(np.int64)
        often = c >= max(p.local_least, p.local_share * len(seen), 3 * total / CELLS + p.local_least)
        v, c = v[often].view(np.int64), c[often]
        for i in range(0, len(v), 10_000):
            m = len(v[i : i + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m), pa.int32()), pa.nulls(m, b.column(0).type), pa.array(c[i : i + 10_000]), pa.array(v[i : i + 10_000]), pa.nulls(m, pa.list_(pa.int64()))], names=["kind", "doc_id", "n", "class", "parity"])

    schema = f"kind int, doc_id {kind}, n long, class long, parity array<long>"
    return written(spark, docs.select("doc_id", "text").mapInArrow(each, schema), "shingle-classes")


def _entries(spark: SparkSession, docs: DataFrame, long_: tuple[np.ndarray, np.ndarray], p: Params) -> DataFrame:
    """What each task deals out of its classes: bucket, and either the entries of that bucket as bytes or a hot shingle's member."""
    parts = partitions(spark) * 4
    hot, often = long_
    t = p.percent
    NAMES = ["bucket", "data", "shingle", "class", "n", "pos"]

    def by_bucket(cold: list[np.ndarray]) -> pa.RecordBatch:
        e = np.concatenate(cold)
        to = (e["shingle"] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cut))
        e, m = e[order], len(some)
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([e[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()), *(pa.nulls(m, pa.int64()) for _ in range(4))], names=NAMES)

    @task("near_duplicates")
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        cold: list[np.ndarray] = []
        held = 0
        for b in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for s in shingle_sets(b.column(0), p.words):
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                at = np.minimum(np.searchsorted(hot, s), max(len(hot) - 1, 0))
                is_hot = hot[at] == s if len(hot) else np.zeros(len(s), bool)
                rest = s[is_hot]
                take = len(s) - -(-t * len(s) // 100) + 1
                first = s[~is_hot][:take]
                e = np.empty(len(first), ENTRY)
                e["shingle"], e["class"], e["n"] = first, c, len(s)
                e["n"][: len(s) - int(_needed(p, 2 * len(s))) + 1] |= EARLY
                cold.append(e)
                held += len(e)
                if take > len(first):
                    counts = often[at[is_hot]]
                    order = np.lexsort((rest, counts))[: take - len(first)]
                    rows[0].extend(rest[order].view(np.int64).tolist())
                    rows[1].extend([c] * len(order))
                    rows[2].extend([len(s)] * len(order))
                    rows[3].extend(range(len(first), len(first) + len(order)))
            if rows[0]:
                # by class, so that a list's members are dealt over all tasks
                m = len(rows[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(rows[1], np.int64) % parts, pa.int32()), pa.nulls(m, pa.binary()), *(pa.array(x, k) for x, k in zip(rows, (pa.int64(),) * 4, strict=True))], names=NAMES)
            if held >= ENTRIES:
                yield from in_pieces(by_bucket(cold), 1_000)
                cold, held = [], 0
        if cold:
            yield from in_pieces(by_bucket(cold), 1_000)

    return docs.select("text").mapInArrow(emit, "bucket int, data binary, shingle long, class long, n long, pos long")


def lists(spark: SparkSession, docs: DataFrame, long_: tuple[np.ndarray, np.ndarray], p: Params) -> DataFrame:
    """Written rows of two kinds: a candidate pair of a short list (a < b, n of each) and a member of a long list (shingle,
    class, n, least place of the shingle in the set's order), each once."""

    @task("near_duplicates")
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        seen: set[tuple[int, int]] = set()
        for b in batches:
            own = b.column(2).is_valid()
            if pa.compute.any(own).as_py():
                x = b.filter(own)
                # copies of a class that lie in other tasks told of the same places
                at = list(zip(x.column(3).to_pylist(), x.column(5).to_pylist(), strict=True))
                x = x.filter(pa.array([k not in seen and not seen.add(k) for k in at], pa.bool_()))
                m = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m), pa.int32()), x.column(2), x.column(3), pa.nulls(m, pa.int64()), x.column(4), pa.nulls(m, pa.int64()), x.column(5)], names=OUT)
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is not None:
                    held.setdefault(k, []).append(data)
        if held:
            for x in _merged(np.frombuffer(b"".join(x for k in list(held) for x in held.pop(k)), ENTRY), p):
                yield from in_pieces(x)

    OUT = ["kind", "shingle", "a", "b", "n", "m", "pos"]
    dealt = _entries(spark, docs, long_, p).repartition(partitions(spark), "bucket")
    return written(spark, dealt.mapInArrow(reduce, "kind int, shingle long, a long, b long, n long, m long, pos long"), "shingle-lists")


def _merged(e: np.ndarray, p: Params) -> Iterator[pa.RecordBatch]:
    """Pairs of short lists whose lengths allow the threshold, and members of long ones."""
    e = e[np.lexsort((e["class"], e["shingle"]))]
    if len(e) > 1:
        e = e[np.append(True, (e["shingle"][1:] != e["shingle"][:-1]) | (e["class"][1:] != e["class"][:-1]))]
    first = np.flatnonzero(np.append(True, e["shingle"][1:] != e["shingle"][:-1])) if len(e) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(e)))
    long_ = np.repeat(size > p.long_list, size)
    out = ["kind", "shingle", "a", "b", "n", "m", "pos"]
    own = (e["n"] & ~EARLY).astype(np.int64)
    pos = np.where(e["n"] & EARLY, 0, own - _needed(p, 2 * own) + 1)  # at least
    if long_.any():
        x = e[long_]
        m = len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m), pa.int32()), pa.array(x["shingle"].view(np.int64)), pa.array(x["class"]), pa.nulls(m, pa.int64()), pa.array(own[long_]), pa.nulls(m, pa.int64()), pa.array(pos[long_])], names=out)
    some = (size > 1) & (size <= p.long_list)
    first, size = first[some], size[some]
    pairs = []
    for d in range(1, int(size.max(initial=1))):
        # every member with the d-th after it
        k = np.maximum(size - d, 0)
        i = np.repeat(first, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        n, m = own[i], own[i + d]
        ok = (100 * np.minimum(n, m) >= p.percent * np.maximum(n, m)) & (np.minimum(n - pos[i], m - pos[i + d]) >= _needed(p, n + m))
        pairs.append(np.stack([e["class"][i][ok], e["class"][i + d][ok], n[ok], m[ok]]))
    if pairs:
        q = np.concatenate(pairs, axis=1)
        swap = q[0] > q[1]
        q[:, swap] = q[:, swap][[1, 0, 3, 2]]
        q = np.unique(q, axis=1)
        m = q.shape[1]
        if m:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m), pa.int32()), pa.nulls(m, pa.int64()), pa.array(q[0]), pa.array(q[1]), pa.array(q[2]), pa.array(q[3]), pa.nulls(m, pa.int64())], names=out)


def _close(p: Params, x: str, y: str, n: Column, m: Column) -> Column:
    """Whether two parity sketches allow the threshold: no more odd buckets than the sets may differ in. A sketch of twice the
    size is folded: its halves are those of half as many buckets."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    k = F.least(F.size(x), F.size(y))
    xor = lambda u, v: u.bitwiseXOR(v)
    half = lambda c: F.when(F.size(c) == k, c).otherwise(F.zip_with(F.slice(c, 1, k), F.slice(c, k + 1, k), xor))
    odd = F.aggregate(F.zip_with(half(x), half(y), lambda u, v: F.bit_count(xor(u, v))), F.lit(0), lambda s, v: s + v)
    # sets whose sketches differ by more than one size are too unlike in length anyway
    return (F.greatest(F.size(x), F.size(y)) <= 2 * k) & (odd <= n + m - 2 * least_overlap(p, n + m))


def in_lists(t: pa.Table, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes of pairs of a list's members, one of them asking, whose sizes, places and sketches allow the threshold. Rows come by list, then size."""
    shingle, part, cls, n, pos, c, open_, asks = (t[k].to_numpy() for k in ("shingle", "part", "class", "n", "pos", "c", "open", "asks"))
    parity = t["parity"].combine_chunks()
    words, at = parity.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(parity.value_lengths().to_numpy())])
    size = np.diff(at)
    own = np.concatenate([[0], np.cumsum((shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1]))]) << 32
    key = own | n
    u = np.flatnonzero(asks)
    lo = np.searchsorted(key, own[u] | -(-p.percent * n[u] // 100))
    many = np.searchsorted(key, own[u] | np.minimum(100 * n[u] // p.percent, (1 << 32) - 1), "right") - lo
    for first, last in runs(np.concatenate([[0], np.cumsum(many)]), PAIRS):
        k = many[first:last]
        i, j = np.repeat(u[first:last], k), np.repeat(lo[first:last] - np.cumsum(k) + k, k) + np.arange(k.sum())
        both = n[i] + n[j]
        need = _needed(p, both)
        # of two open members each asks for the other
        ok = (c[i] != c[j]) & (~open_[j] | (cls[i] < cls[j])) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
        i, j, most = i[ok], j[ok], (both - 2 * need)[ok]
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        for w in np.unique(small).tolist():
            some = np.flatnonzero((small == w) & (large <= 2 * w))  # as in _close
            for s in range(0, len(some), max(1, LONGS // w)):
                x = some[s : s + max(1, LONGS // w)]
                odd = np.zeros(len(x), np.int64)
                for a, b in ((0, w // 2), (w // 2, w)):
                    bits = [_words(words, at[m], size[m] > w, a, b, w) for m in (i[x], j[x])]
                    odd += np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
                    x, odd = x[left := odd <= most[x]], odd[left]
                yield cls[i[x]], cls[j[x]]


def _words(words: np.ndarray, at: np.ndarray, folds: np.ndarray, a: int, b: int, w: int) -> np.ndarray:
    """Words a to b of sketches of w words that begin at some places; those that fold have 2 w."""
    place = at[:, None] + np.arange(a, b)
    out = words[place]
    out[folds] ^= words[place[folds] + w]
    return out


def probed(spark: SparkSession, members: DataFrame, p: Params) -> DataFrame:
    """Pairs (a < b) of members of a list that lie in different components c, one of them open, and may reach the threshold. members: shingle,
    class, n, pos, c, open, parity, size (of the list). The open ones of a list are dealt by BLOCK, each part held against all of the list."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class"), parts)
    dealt = members.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), own.alias("own")).withColumn("asks", F.col("open") & (F.col("own") == F.col("part")))
    dealt = dealt.select("shingle", "part", "class", "n", "pos", "c", "open", "asks", "parity").repartition(partitions(spark), "shingle", "part").sortWithinPartitions("shingle", "part", "n")

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for a, b in in_lists(t, p):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    @task("near_duplicates")
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, most = 0, ROWS
        for x in batches:
            held.append(x)
            rows += len(x)
            if rows < most:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            shingle, part = t["shingle"].to_numpy(), t["part"].to_numpy()
            edges = np.flatnonzero((shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1]))
            done = int(edges[-1]) + 1 if len(edges) else 0
            if done:
                yield from pairs(t.slice(0, done).combine_chunks())
            held = t.slice(done).combine_chunks().to_batches()
            rows -= done
            most = max(ROWS, 2 * rows)  # a list is held whole
        if rows:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(each, "a long, b long")


def _sets(spark: SparkSession, docs: DataFrame, wanted: DataFrame, n: int, p: Params) -> DataFrame:
    """Written (class, shingles as bytes) of wanted classes (class, least doc_id), n at most, without moving a text. A bit sieve of
    the ids of their first documents tells which texts are cut into shingles at all; another, of both, lets few others through, which do no harm."""
    size = sieve_bits(len(STEPS) * n)
    cls, id_ = F.pmod("class", F.lit(size)), F.pmod(F.coalesce("least", F.lit(0)), F.lit(size))
    first, bits = (sieve(wanted.select(F.explode(F.array(*k)).alias("k")), size) for k in ([id_], [F.pmod(cls + k * id_, F.lit(size)) for k in STEPS]))
    bits = bits.tobytes()

    @task("near_duplicates")
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            at = pa.compute.fill_null(b.column(0), 0).to_numpy() % size
            b = b.filter(pa.array((first[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            if not len(b):
                continue
            cls, data = [], []
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), p.words), strict=True):
                if len(s):
                    c = class_of(s)
                    if c not in seen and all(bits[(at := (c % size + k * ((i or 0) % size)) % size) >> 3] >> (at & 7) & 1 for k in STEPS):
                        seen.add(c)
                        cls.append(c)
                        data.append(s.tobytes())
            if cls:
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(data, pa.binary())], names=["class", "data"])

    return written(spark, docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "class long, data binary"), "shingle-sets", "none")


def divide_skip(query: np.ndarray, block: list[np.ndarray], p: Params) -> np.ndarray:
    """Which sets of a block reach the threshold with the query set. All are ascending; every answer is exact.

    The query's shingles have inverted lists over the block. A set of m shingles needs T = least overlap of n and m; T of the smallest
    set is what all need. The L longest lists are set aside (L by the rule of DivideSkip, T / (mu log2 M + 1), M the longest list's
    length); the others are merged, and a set that occurs in fewer than T - L of them is out. The sets left are looked up in the long
    lists by binary search, one list after the other, as long as the threshold can still be reached.
    """
    n, m = len(query), np.array([len(s) for s in block])
    need = -(-p.percent * (n + m) // (100 + p.percent))
    if not n:
        return np.zeros(len(block), bool)
    # postings: place of the shingle in the query, number of the set; sorted by shingle, then set
    every, who = np.concatenate(block), np.repeat(np.arange(len(block)), m)
    at = np.minimum(np.searchsorted(query, every), n - 1)
    hit = query[at] == every
    at, who = at[hit], who[hit]
    length = np.bincount(at, minlength=n)
    if len(block) == 1:  # lists of one member each: their merge is the count
        return np.array([len(at) >= need[0]])
    least, longest = int(need.min()), int(length.max())
    aside = min(least - 1, int(least / (MU * np.log2(longest) + 1))) if longest > 1 else 0
    order = np.argsort(length, kind="stable")
    is_long = np.zeros(n, bool)
    is_long[order[n - aside :]] = True
    seen = np.bincount(who[~is_long[at]], minlength=len(block))
    left = np.flatnonzero(seen >= need - aside)
    by_list = np.argsort(at, kind="stable")
    who, begin = who[by_list], np.concatenate([[0], np.cumsum(length)])
    for done, k in enumerate(order[n - aside :].tolist()):
        if not len(left):
            break
        own = who[begin[k] : begin[k + 1]]
        if len(own):
            i = np.minimum(np.searchsorted(own, left), len(own) - 1)
            seen[left] += own[i] == left
        left = left[seen[left] + (aside - done - 1) >= need[left]]
    out = np.zeros(len(block), bool)
    out[left] = seen[left] >= need[left]
    return out


def _verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, by_class: DataFrame, p: Params) -> DataFrame:
    """Written links: pairs (a, b) of classes that reach the threshold, counted on whole sets. Only sets of these pairs move."""

    @task("near_duplicates")
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy()
            # neighbouring rows of one query set are a block
            edges = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist() if len(own) else []
            ok = np.zeros(len(own), bool)
            for i, j in zip(edges, [*edges[1:], len(own)], strict=True):
                x = np.frombuffer(b.column(2)[i].as_buffer(), np.uint64)
                ok[i:j] = divide_skip(x, [np.frombuffer(b.column(3)[k].as_buffer(), np.uint64) for k in range(i, j)], p)
            yield b.select([0, 1]).filter(pa.array(ok))

    pairs = written(spark, pairs.select("a", "b"), "shingle-to-count")
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().join(by_class.select("class", "least"), "class")
    sets = _sets(spark, docs, needed, 2 * pairs.count(), p)
    left = sets.select(F.col("class").alias("a"), F.col("data").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("data").alias("y"))
    # the join by a comes last, so where it is one by sorting, a query's candidates come side by side
    return written(spark, pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(each, "a long, b long"), "shingle-links")


def _lists(spark: SparkSession, docs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written: a row for each document (doc_id, n, class, parity), one for each class (class, n, parity, least doc_id), and lists()."""
    found = classes(spark, docs, p)
    rows = found.where("kind = 0").drop("kind")
    top = numbers(found.where("kind = 1").groupBy("class").agg(F.sum("n").alias("k")).orderBy(F.desc("k"), "class").limit(p.most_long))
    hot = top["class"].view(np.uint64)
    order = np.argsort(hot)
    long_ = (hot[order], top["k"][order])
    del top
    trim()
    by_class = written(spark, rows.where("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.first("parity").alias("parity"), F.min("doc_id").alias("least")), "shingle-by-class")
    return rows, by_class, lists(spark, docs, long_, p)


def links(spark: SparkSession, docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """The join itself: every pair (a < b) of classes that reach the threshold, and the membership (doc_id, class, n_links: classes that
    the document's own is linked with). Copies are one class, never pairs. The pairs of a group of near copies grow with its square, as
    they are the result; near_duplicates() needs components alone and works without them."""
    rows, by_class, listed = _lists(spark, docs, p)
    sketch = lambda k: by_class.select(F.col("class").alias(k), F.col("parity").alias(f"p{k}"))
    member = listed.where("kind = 1").select("shingle", F.col("a").alias("class"), "n", "pos")
    sizes = member.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"))
    every = member.join(sizes, "shingle").join(by_class.select("class", "parity"), "class").withColumns({"c": F.col("class"), "open": F.lit(True)})
    short = listed.where("kind = 0").select("a", "b", "n", "m").distinct().join(sketch("a"), "a").join(sketch("b"), "b").where(_close(p, "pa", "pb", F.col("n"), F.col("m")))
    pairs = short.select("a", "b").union(probed(spark, every, p)).distinct()
    found = _verified(spark, docs, pairs, by_class, p)
    many = found.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n_links"))
    members = rows.select("doc_id", F.when(F.col("n") > 0, F.col("class")).alias("class")).join(many, F.col("class") == F.col("k"), "left")
    return found, members.select("doc_id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(spark: SparkSession, docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    rows, by_class, listed = _lists(spark, docs, p)
    sketch = lambda k: by_class.select(F.col("class").alias(k), F.col("parity").alias(f"p{k}"))

    short = listed.where("kind = 0").groupBy("a", "b").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.count(F.lit(1)).alias("shared"))
    member = written(spark, listed.where("kind = 1").select("shingle", F.col("a").alias("class"), "n", "pos"), "shingle-members")
    lists_of = member.groupBy("class").agg(F.count(F.lit(1)).alias("lists"))
    member = written(spark, member.join(lists_of, "class"), "shingle-members")
    centre = written(spark, member.groupBy("shingle").agg(F.max(F.struct("lists", "n", "class", "pos")).alias("c")).select("shingle", F.col("c.class").alias("b"), F.col("c.n").alias("m"), F.col("c.pos").alias("at")), "shingle-centres")
    star = member.join(centre, "shingle").where((F.col("class") != F.col("b")) & (100 * F.least("n", "m") >= p.percent * F.greatest("n", "m")) & _ahead(p, "n", "pos", "m", "at"))
    star = star.groupBy(F.col("class").alias("a"), "b").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.count(F.lit(1)).alias("shared"))
    near = lambda df: df.join(sketch("a"), "a").join(sketch("b"), "b").where(_close(p, "pa", "pb", F.col("n"), F.col("m"))).select("a", "b", "shared")
    pairs, star = written(spark, near(short), "shingle-pairs"), near(star)

    # one partner for each class
    way = pairs.union(pairs.select("b", "a", "shared")).union(star)
    best = way.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b"))
    first = written(spark, best.distinct(), "shingle-first")
    links = _verified(spark, docs, first, by_class, p)
    found = components(spark, links)

    released(spark)
    # what is left lies between components
    comp = lambda k: found.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    own = lambda k: F.coalesce(f"c{k}", k)
    rest = pairs.select("a", "b").join(comp("a"), "a", "left").join(comp("b"), "b", "left").where(own("a") != own("b")).select("a", "b")
    placed = member.join(comp("class"), "class", "left").select("shingle", "class", "n", "pos", own("class").alias("c"))
    sizes = placed.groupBy("shingle", "c").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("k", "c")).alias("x"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("size")).where("parts > 1").select("shingle", F.col("x.c").alias("main"), "size")
    main = written(spark, main, "shingle-main")
    other = placed.join(main, "shingle").withColumn("open", F.col("c") != F.col("main")).join(by_class.select("class", "parity"), "class")
    probe = probed(spark, other, p)
    rest = rest.union(probe).distinct().join(first, ["a", "b"], "left_anti")
    more = _verified(spark, docs, rest, by_class, p)
    found = components(spark, links.union(more))

    placed = by_class.join(found, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("component", "class").alias("c"))
    named = placed.groupBy("c").agg(F.min("least").alias("component_id"))
    named = placed.join(named, "c").select(F.col("class").alias("k"), "component_id")
    out = rows.join(named, (F.col("class") == F.col("k")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(spark, docs)


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id. Rows with a null id go by a hash of their text, behind
    all ids; of rows that share an id the first by a hash of the text stays. Documents without words stay."""
    key, gone, first = fresh(docs, 3)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))))
    found = near_duplicates(spark, keyed.select(F.col(key).alias("doc_id"), "text"))
    found = written(spark, found.select(F.col("doc_id").alias(gone), (F.col("doc_id") == F.col("component_id")).alias("stays")), "near-kept")
    released(spark)
    away = written(spark, found.groupBy(gone).agg(F.max("stays").alias("stays")).where("not stays").select(gone), "near-gone")
    kept = keyed.join(away, F.col(key) == F.col(gone), "left_anti")
    order = Window.partitionBy(key).orderBy(F.xxhash64("text"))
    return kept.withColumn(first, F.row_number().over(order)).where(F.col(first) == 1).select(*docs.columns)


def oracle() -> str:
    """By brute force: all pairs that share a shingle, counted; components by repeated minimum."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(x) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.d WHERE r.c < e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(m.c AS BIGINT) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = d.doc_id"""
