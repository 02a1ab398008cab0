"""Removal of repeated byte strings by prefix-free parsing.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller doc_id, or earlier in the same document).

Parsing. Rolling hashes of GRAM bytes are triggers: among the grams of a string of `length` bytes the least hash (leftmost of
equals) is its trigger. Consecutive starts with one trigger form a phrase: the bytes from the first start to the end of the
last string. The trigger of a string depends on nothing outside of it, so equal strings stand at equal places beside equal
grams. The dictionary is the set of distinct phrases; the parse is the order of their places.

Parse. Phrases are sorted by trigger, then by phrase (BLAKE2b-128 of its bytes stands for its rank), then by place. As every string
lies inside its phrase, the parse's suffixes need no more than their first phrase: a trigger gram that occurs once settles all its
starts, and of equal phrases all but the first in corpus order are repeats as a whole.

Dictionary. Strings of different triggers differ, so the dictionary's suffix array is built trigger by trigger, and only where
different phrases share one: `suffix_ranks` sorts those phrases' suffixes by their first `length` bytes, by doubling, letter for letter.
Suffixes of one rank, in order of their phrases' places in the parse, are the corpus order; all but the first are repeats.

Scale. Per trigger a phrase travels as some 33 bytes; texts move only for documents with a shared trigger, twice at most.
Tasks drop their own repeats first. Grams with many different phrases (the edges of a passage that a third of all documents
holds) are settled by single strings, keyed by the string's BLAKE2b-128, of which each task sends the first alone. So no key gathers
more than a few entries a task. Rolling hashes choose triggers and partitions only; a chance meeting of theirs costs work and removes nothing.

Null and empty texts, and those under `length` bytes, keep all bytes. Rows with a null doc_id come last, by a hash of their
text. Rows that repeat with id and text are repeats of the first of them. An empty table gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.bytewords import BYTE_VALUE, PIECE, powers
from graphloom.llm.common import bounded_batches, in_pieces, mixed, partitions, runs, sieve, sieve_bits, task, utf8, written

GRAM = 32
LAST = (1 << 63) - 1
#: Kinds of marks: all starts from lo to hi repeat earlier ones; starts to settle by single strings or by trigger; a row that
#: repeats with its id.
REPEAT, BY_STRING, BY_TRIGGER, SAME_ROW = 1, 2, 3, 4


@dataclass(frozen=True)
class Params:
    length: int = 100
    flush_bytes: int = 16 << 20  # text of a task between two sortings
    local_phrases: int = 64  # different phrases of a gram in one flush, beyond which it is settled by strings
    phrases: int = 4096  # the same in all
    sorted_bytes: int = 1 << 20  # of phrases whose suffixes are sorted at once, if no trigger has more


class Hashes:
    """Hashes of any data[i:j] from running sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[:-1], out=self.run[1:])

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mixed((self.run[j] - self.run[i]) * self.down[i] + (j - i).astype(np.uint64))


def digests(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """BLAKE2b-128 of each data[first:last] as two numbers."""
    view = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join([hashlib.blake2b(view[i:j], digest_size=16).digest() for i, j in zip(first.tolist(), last.tolist(), strict=True)]), "<u8").reshape(-1, 2)


def suffix_ranks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the strings data[i:i + length] for i in `at`, by their bytes: equal strings have equal ranks, smaller ones smaller ranks.

    All suffixes are sorted by eight bytes, then by 16, 32 and so on, each time from two ranks of half as many. What a suffix lacks behind
    the end of the data counts as zeros; no string of `at` reaches there.
    """
    n = len(data)
    key = np.ndarray((n,), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,)).astype(np.uint64)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    width = 8
    while width < length:
        step = min(width, length - width)  # the last step overlaps
        behind = np.zeros(n, np.int64)
        behind[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + behind, return_inverse=True)[1].astype(np.int64)
        width += step
    return rank[at]


def phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each phrase of a piece of texts: trigger hash, phrase digest, text number, first and last start, trigger (from the text's start)."""
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    if not sizes.sum():
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    h = Hashes(data)
    gram = mixed((h.run[GRAM:] - h.run[:-GRAM]) * h.down[: len(data) - GRAM + 1])
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width, c = length - GRAM + 1, 1
    while 2 * c <= width:
        least, c = np.minimum(least[:-c], least[c:]), 2 * c
    if c < width:
        least = np.minimum(least[: len(least) - (width - c)], least[width - c :])
    p = np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    text = np.repeat(np.arange(len(sizes)), sizes)
    a = (least[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    lo, hi, a, text = p[first], p[last], a[first], text[first]
    whole = digests(data, lo, hi + length)
    at = offsets[text]
    return h(a, a + GRAM), whole[:, 0], whole[:, 1], text, lo - at, hi - at, a - at


ENTRY = np.dtype([("gram", "<u8"), ("whole", "<u8"), ("other", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("lo", "<i8"), ("hi", "<i8"), ("at", "<i8"), ("hot", "?")])
#: Of a trigger's hash 48 bits travel; a chance meeting only costs a comparison of whole phrases.


def _to(gram: np.ndarray, n: int) -> np.ndarray:
    """The partition of a trigger, by other bits than those that are compared and some of them."""
    return ((gram >> np.uint64(24)) % np.uint64(n)).astype(np.int64)


def _pack(e: np.ndarray) -> bytes:
    """Column by column, in as few bytes as hold them. e is sorted by document."""
    new = np.append(True, (e["doc"][1:] != e["doc"][:-1]) | (e["tag"][1:] != e["tag"][:-1]))
    at = np.flatnonzero(new)
    lo = e["lo"].astype("<u4").view("<u2").reshape(-1, 2)
    grams = np.ascontiguousarray(e["gram"].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    parts = [np.array([len(e), len(at)], "<u4"), e["doc"][at], e["tag"][at], np.diff(np.append(at, len(e))).astype("<u4"), grams, e["whole"], e["other"], np.ascontiguousarray(lo[:, 0]), np.ascontiguousarray(lo[:, 1]), (e["hi"] - e["lo"]).astype(np.uint8), (e["at"] - e["lo"]).astype(np.uint8), e["hot"].astype(np.uint8)]
    return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


def _unpack(data: bytes) -> np.ndarray:
    n, d = (int(x) for x in np.frombuffer(data, "<u4", 2))
    at = 8

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, kind, k, at)
        at += x.nbytes
        return x

    e = np.empty(n, ENTRY)
    doc, tag, many = take("<i8", d), take("<i8", d), take("<u4", d)
    e["doc"], e["tag"] = np.repeat(doc, many), np.repeat(tag, many)
    grams = np.zeros((n, 8), np.uint8)
    grams[:, :6] = take("u1", 6 * n).reshape(n, 6)
    e["gram"], e["whole"], e["other"] = grams.view("<u8")[:, 0], take("<u8", n), take("<u8", n)
    e["lo"] = take("<u2", n).astype(np.int64) + (take("<u2", n).astype(np.int64) << 16)
    e["hi"], e["at"], e["hot"] = e["lo"] + take("u1", n), e["lo"] + take("u1", n), take("u1", n)
    return e


MARK = ["bucket", "data", "doc", "tag", "lo", "hi", "at", "kind"]
MARK_SCHEMA = "bucket int, data binary, doc long, tag long, lo long, hi long, at long, kind int"


def _marks(e: np.ndarray, kind: int, buckets: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(e)
    k = pa.nulls(n, pa.int32()) if buckets is None else pa.array(buckets, pa.int32())
    return pa.RecordBatch.from_arrays([k, pa.nulls(n, pa.binary()), *(pa.array(e[c]) for c in ("doc", "tag", "lo", "hi", "at")), pa.array(np.full(n, kind), pa.int32())], names=MARK)


def _settle(e: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, int]], np.ndarray, np.ndarray]:
    """Sorted entries, the repeats among them, a mask of first phrases, and how many different phrases each entry's gram has."""
    if not len(e):
        return e, [], np.zeros(0, bool), np.zeros(0, np.int64)
    e = e[np.lexsort((e["lo"], e["tag"], e["doc"], e["other"], e["whole"], e["gram"]))]
    gram = np.append(True, e["gram"][1:] != e["gram"][:-1])
    whole = gram | np.append(True, (e["whole"][1:] != e["whole"][:-1]) | (e["other"][1:] != e["other"][:-1]))
    same = ~whole & np.append(False, (e["doc"][1:] == e["doc"][:-1]) & (e["tag"][1:] == e["tag"][:-1]) & (e["lo"][1:] == e["lo"][:-1]))
    of = np.cumsum(gram) - 1
    many = np.bincount(of, weights=whole, minlength=len(e)).astype(np.int64)[of] if len(e) else np.zeros(0, np.int64)
    return e, [(e[~whole & ~same], REPEAT), (e[same], SAME_ROW)], whole, many


def even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n hash partitions an integer that Spark's hash sends there."""
    tries = spark.range(40 * n + 1000).select(F.col("id").cast("int").alias("k"))
    rows = tries.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()
    found = {r["p"]: r["k"] for r in rows}
    return np.array([found.get(i, i) for i in range(n)], np.int32)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("tag"), "text")


def marks(spark: SparkSession, keyed: DataFrame, keys: np.ndarray, p: Params) -> DataFrame:
    """Written marks after triggers and whole phrases are sorted."""
    n = len(keys)

    @task("suffix_dedup")
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            e, found, first, many = _settle(np.concatenate(held))
            for x, kind in found:
                if len(x):
                    yield from in_pieces(_marks(x, kind, keys[np.arange(len(x)) % n]))
            e, many = e[first], many[first]
            hot = many > p.local_phrases
            if hot.any():
                x = e[hot]
                yield _marks(x, BY_STRING, keys[np.arange(len(x)) % n])
                x = x[np.append(True, x["gram"][1:] != x["gram"][:-1])].copy()  # one of them tells that the gram is settled by strings
                x["hot"] = True
                e = np.concatenate([e[~hot], x])
            to = _to(e["gram"], n)
            order = np.lexsort((e["tag"], e["doc"], to))
            e, to = e[order], to[order]
            cut = np.searchsorted(to, np.arange(n + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([keys[k]], pa.int32()), pa.array([_pack(e[cut[k] : cut[k + 1]])], pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.int32())], names=MARK)

        for b in batches:
            data, offsets = utf8(b.column(2))
            doc, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in runs(offsets, PIECE):
                gram, whole, other, text, lo, hi, at = phrases(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p.length)
                e = np.empty(len(gram), ENTRY)
                e["gram"], e["whole"], e["other"], e["doc"], e["tag"], e["lo"], e["hi"], e["at"], e["hot"] = gram, whole, other, doc[i + text], tag[i + text], lo, hi, at, False
                held.append(e)
                size += int(offsets[j] - offsets[i])
                if size >= p.flush_bytes:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    @task("suffix_dedup")
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            own = b.column(1).is_null()
            x = b.filter(own)
            if len(x):
                yield x
            held += [_unpack(d.as_buffer()) for d in b.column(1).filter(pa.compute.invert(own))]
        if held:
            e, found, first, many = _settle(np.concatenate(held))
            for x, kind in found:
                x = x[~x["hot"]]
                if len(x):
                    yield from in_pieces(_marks(x, kind))
            of = np.cumsum(np.append(True, e["gram"][1:] != e["gram"][:-1])[: len(e)]) - 1
            hot = (np.bincount(of, weights=e["hot"])[of] > 0) | (many > p.phrases) if len(e) else np.zeros(0, bool)
            first &= ~e["hot"]
            for x, kind in ((e[first & hot], BY_STRING), (e[first & ~hot & (many > 1)], BY_TRIGGER)):
                if len(x):
                    yield from in_pieces(_marks(x, kind))

    dealt = keyed.select("doc", "tag", "text").mapInArrow(parse, MARK_SCHEMA).repartition(n, "bucket")
    return written(spark, dealt.mapInArrow(sort, MARK_SCHEMA).select("doc", "tag", "lo", "hi", "at", "kind"), "phrase-marks")


def _with_marks(spark: SparkSession, keyed: DataFrame, found: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Texts with their marks (array of lo, hi, at, kind), and the other texts. A bit sieve, filled from all marks, keeps most texts
    without marks from being moved."""
    marked = found.select("doc", "tag").distinct()
    size = sieve_bits(marked.count())
    place = F.pmod(F.xxhash64("doc", "tag"), F.lit(size))
    bits = sieve(marked.select(place.alias("k")), size).tobytes()

    @task("suffix_dedup")
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(bits, np.uint8)
        for b in batches:
            at = b.column(b.schema.get_field_index("maybe")).to_numpy()
            yield b.set_column(b.schema.get_field_index("maybe"), "maybe", pa.array(((own[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64)))

    kind = dict(keyed.dtypes)["doc_id"]
    seen = keyed.withColumn("maybe", place).mapInArrow(through, f"doc_id {kind}, doc long, tag long, text string, maybe long")
    per = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi", "at", "kind")).alias("marks"))
    joined = seen.where("maybe = 1").join(per.hint("merge"), ["doc", "tag"], "left")
    return joined, seen.where("maybe = 0")


WINDOW = np.dtype([("hash", "<u8"), ("other", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("lo", "<i8")])


def _repeats(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First strings, and the others as marks of single starts."""
    w = w[np.lexsort((w["lo"], w["tag"], w["doc"], w["other"], w["hash"]))]
    first = np.append(True, (w["hash"][1:] != w["hash"][:-1]) | (w["other"][1:] != w["other"][:-1])) if len(w) else np.zeros(0, bool)
    return w[first], w[~first]


def _runs(w: np.ndarray) -> pa.RecordBatch:
    """Single starts as runs."""
    w = w[np.lexsort((w["lo"], w["tag"], w["doc"]))]
    new = np.append(True, (w["lo"][1:] > w["lo"][:-1] + 1) | (w["doc"][1:] != w["doc"][:-1]) | (w["tag"][1:] != w["tag"][:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(w)) - 1
    m = len(first)
    return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.array(w["doc"][first]), pa.array(w["tag"][first]), pa.array(w["lo"][first]), pa.array(w["lo"][last]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names=OPEN)


OPEN = ["bucket", "doc", "tag", "lo", "hi", "hash", "other", "bytes"]
OPEN_SCHEMA = "bucket int, doc long, tag long, lo long, hi long, hash long, other long, bytes binary"


def suffixes(spark: SparkSession, keyed: DataFrame, open_: DataFrame, keys: np.ndarray, p: Params) -> DataFrame:
    """Written repeats (doc, tag, lo, hi) among the suffixes of open phrases."""
    n = len(keys)
    texts, _ = _with_marks(spark, keyed, open_, p)

    @task("suffix_dedup")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            single: list[np.ndarray] = []
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, tag, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = text.encode()
                for m in own:
                    lo, hi, at = m["lo"], m["hi"], m["at"]
                    piece = data[lo : hi + p.length]
                    x = np.frombuffer(piece, np.uint8)
                    if m["kind"] == BY_TRIGGER:
                        gram = Hashes(x)(np.array([at - lo]), np.array([at - lo + GRAM]))
                        for r, v in zip(rows, (keys[_to(gram, n)[0]], doc, tag, lo, piece, gram.view(np.int64)[0]), strict=True):
                            r.append(v)
                    else:
                        k = np.arange(hi - lo + 1)
                        w = np.empty(len(k), WINDOW)
                        own_hash = digests(x, k, k + p.length)
                        w["hash"], w["other"], w["doc"], w["tag"], w["lo"] = own_hash[:, 0], own_hash[:, 1], doc, tag, lo + k
                        single.append(w)
            m = len(rows[0])
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(rows[5], pa.int64()), pa.array(rows[4], pa.binary())], names=OPEN)
            if single:
                w, again = _repeats(np.concatenate(single))
                if len(again):
                    x = _runs(again)
                    yield x.set_column(0, "bucket", pa.array(keys[np.arange(len(x)) % n], pa.int32()))
                m = len(w)
                yield pa.RecordBatch.from_arrays([pa.array(keys[(w["hash"] % np.uint64(n)).astype(np.int64)], pa.int32()), pa.array(w["doc"]), pa.array(w["tag"]), pa.array(w["lo"]), pa.nulls(m, pa.int64()), pa.array(w["hash"].copy().view(np.int64)), pa.array(w["other"].copy().view(np.int64)), pa.nulls(m, pa.binary())], names=OPEN)

    @task("suffix_dedup")
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, held = [], []
        for b in batches:
            x = b.filter(b.column(4).is_valid())
            if len(x):
                yield x
            x = b.filter(b.column(5).is_valid())
            if len(x):
                w = np.empty(len(x), WINDOW)
                w["hash"], w["other"], w["doc"], w["tag"], w["lo"] = (x.column(c).to_numpy() if c < 5 else x.column(c).to_numpy().view(np.uint64) for c in (5, 6, 1, 2, 3))
                strings.append(w)
            x = b.filter(b.column(7).is_valid())
            if len(x):
                held.append(x.select([1, 2, 3, 6, 7]))
        if strings:
            again = _repeats(np.concatenate(strings))[1]
            strings.clear()
            if len(again):
                yield from in_pieces(_runs(again))
        if held:
            x = pa.Table.from_batches(held)
            held.clear()
            gram = x.column(3).to_numpy()
            order = np.argsort(gram, kind="stable")
            x, gram = x.take(pa.array(order)), gram[order]
            # the dictionary, some triggers at a time, end to end: no string goes over a phrase's end
            new = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            ends = np.cumsum(pa.compute.binary_length(x.column(4)).to_numpy().astype(np.int64))
            for i, j in runs(np.append(0, ends[np.append(new[1:], len(gram)) - 1]), p.sorted_bytes):
                again = _repeats(_suffixes(x.slice(new[i], (new[j] if j < len(new) else len(gram)) - new[i]), p))[1]
                if len(again):
                    yield from in_pieces(_runs(again))

    pieces = texts.where("marks is not null").select("doc", "tag", "text", "marks").mapInArrow(cut, OPEN_SCHEMA)
    return written(spark, pieces.repartition(n, "bucket").mapInArrow(sort, OPEN_SCHEMA).select("doc", "tag", "lo", "hi"), "phrase-repeats")


def _suffixes(x: pa.Table, p: Params) -> np.ndarray:
    """All strings of some phrases (doc, tag, lo, gram, bytes), with their ranks as hashes."""
    data, offsets = utf8_of(x.column(4).combine_chunks())
    k = np.diff(offsets) - p.length + 1
    i = np.repeat(np.arange(len(k)), k)
    at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    w = np.empty(len(i), WINDOW)
    w["hash"], w["other"] = suffix_ranks(data, offsets[:-1][i] + at, p.length), 0
    w["doc"], w["tag"], w["lo"] = x.column(0).to_numpy()[i], x.column(1).to_numpy()[i], x.column(2).to_numpy()[i] + at
    return w


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def kept(text: str, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that stay and the removed runs, for starts lo to hi of removed strings."""
    data = text.encode()
    spans: list[tuple[int, int]] = []
    order = np.argsort(lo, kind="stable")
    for i, j in zip(lo[order].tolist(), hi[order].tolist(), strict=True):
        j += length
        if spans and i <= spans[-1][1]:
            if j > spans[-1][1]:
                spans[-1] = (spans[-1][0], j)
        else:
            spans.append((i, j))
    at, parts = 0, []
    for i, j in spans:
        parts.append(data[at:i])
        at = j
    return b"".join([*parts, data[at:]]), spans


def deduplicate(spark: SparkSession, docs: DataFrame, p: Params = Params(), with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with_bytes: the remaining bytes) of each row of docs."""
    bounded_batches(spark)
    keyed = _keyed(docs)
    keys = even_keys(spark, partitions(spark))
    found = marks(spark, keyed, keys, p)
    more = suffixes(spark, keyed, found.where(F.col("kind").isin(BY_STRING, BY_TRIGGER)), keys, p)
    closed = found.where(F.col("kind").isin(REPEAT, SAME_ROW)).select("doc", "tag", "lo", "hi", "at", "kind")
    closed = closed.unionByName(more.select("doc", "tag", "lo", "hi", F.lit(0).cast("long").alias("at"), F.lit(REPEAT).alias("kind")))
    texts, rest = _with_marks(spark, keyed, closed, p)
    kind = dict(docs.dtypes)["doc_id"]
    texts = texts.withColumn("again", F.row_number().over(Window.partitionBy("doc", "tag").orderBy("doc")) > 1)

    @task("suffix_dedup")
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            own = b.column(2)
            for i, (text, again) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                size = len(text.encode())
                if again and size >= p.length:
                    lo, hi = np.array([0]), np.array([size - p.length])
                elif own[i].is_valid:
                    flat = own[i].values
                    use = flat.field("kind").to_numpy() == REPEAT
                    lo, hi = flat.field("lo").to_numpy()[use], flat.field("hi").to_numpy()[use]
                else:
                    lo = hi = np.zeros(0, np.int64)
                left, spans = kept(text, lo, hi, p.length)
                for o, v in zip(out, (size, size - len(left), len(spans), hashlib.sha256(left).hexdigest(), left), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, k) for o, k in zip(out[:4], (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)), *([pa.array(out[4], pa.binary())] if with_bytes else [])], names=NAMES)

    NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else [])]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    zero = F.lit(0).cast("long")
    untouched = [F.col("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").cast("binary").alias("kept")] if with_bytes else [])]
    return texts.select("doc_id", "text", "marks", "again").mapInArrow(remove, schema).unionByName(rest.select(*untouched))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return deduplicate(spark, docs)
