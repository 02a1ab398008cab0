"""Token ids as binary shards: concatenated ids with Elias-Fano coded document boundaries.

Documents are dealt by ranges of doc_id (ties by a hash of the text, null ids last), sorted inside each range, encoded in
Arrow batches and cut into shards of bounded size. A shard is one binary value of a table in the shared folder, so Spark's
writers commit it, a lost executor's shards are written anew, and any store Spark writes to will do.

Shard, little-endian: magic "GLTOK1", u8 bytes an id (2 where all ids fit, else 4), u64 documents, u64 ids, u64 documents
without id, i64 least doc_id, Elias-Fano of the documents' ends, Elias-Fano of doc_id less the least, the ids. The table adds
the range's number, the shard's number in it and the ids before it in that range; the ids before a range are a sum over
earlier ranges, of which there are no more than shuffle partitions.

Null and empty texts are the end id alone. Rows that repeat stay apart, each with its place; as the order is one of id and text, rows
that share both share a range. Rows with a null doc_id come
last. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import CACHES, bounded_batches, partitions, task, utf8, written
from graphloom.llm.elias_fano import EliasFano, encode

MAGIC = b"GLTOK1"
HEAD = struct.Struct("<6sBQQQq")
SHARDS = "range int, shard int, before long, n_ids long, n_docs long, data binary"


@dataclass(frozen=True)
class Params:
    tokenizer: str  # path of a vocabulary file of the tokenizers library
    end_id: int = 0
    shard_ids: int = 1 << 19  # a shard ends with the batch that reaches it
    cached_words: int = 1_600_000  # of a Python worker
    cached_pieces: int = 700_000
    batch_docs: int = 1200


def _no_letter_first(column: pa.Array, texts: list[str]) -> np.ndarray:
    """Which texts are empty or begin with white space; only what begins beyond ASCII is looked at one by one."""
    if not len(column):
        return np.zeros(0, bool)
    data, offsets = utf8(column)
    size = np.diff(offsets)
    first = np.append(data, np.uint8(0))[offsets[:-1]]
    out = (size == 0) | (first == 32) | ((first >= 9) & (first <= 13)) | ((first >= 28) & (first <= 31))
    for i in np.flatnonzero((first >= 128) & (size > 0)).tolist():
        out[i] = texts[i][0].isspace()
    return out


class Encoder:
    """The tokenizer over batches of texts, with a cache of words.

    The tokenizer's byte-level split never joins a space to what is before it, unless white space stands on both sides. So a
    text is cut at each space and each distinct piece of a batch is encoded once, as it would be in its text; ids are then put
    together by index. Texts with a space before white space (or at their end) are encoded whole. A piece of letters with
    marks behind them is cut once more between the two, where the split parts them always. The cache never changes the ids.
    """

    MARKS = ".,;:!?)]}$&%#*\"|"

    def __init__(self, p: Params):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has a core; threads of its own would only take memory
        from tokenizers import Tokenizer

        self.own, self.p = Tokenizer.from_file(p.tokenizer), p
        self.width = 2 if self.own.get_vocab_size() <= 1 << 16 and p.end_id < 1 << 16 else 4
        # of words behind a space and of others, which have none before them
        self.words: dict[str, dict[str, bytes]] = {" ": {}, "": {"": b""}}
        self.old: dict[str, dict[str, bytes]] = {" ": {}, "": {}}
        self.pieces: dict[str, dict[str, bytes]] = {" ": {}, "": {}}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.width == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, words: Iterable[str], lead: str) -> dict[str, bytes]:
        """The cache of words behind `lead`, with these words."""
        known = self.words[lead]
        if len(known) > self.p.cached_words // 2:
            self.old[lead], known = known, {"": b""} if not lead else {}  # words in use come back from the older half
            self.words[lead] = known
        old = self.old[lead]
        new = [w for w in dict.fromkeys(words) if w not in known]
        known.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in known]
        known.update(zip(new, self._encoded([lead + w for w in new] if lead else new), strict=True))
        return known

    def _pieces(self, pieces: list[str], lead: str) -> list[bytes]:
        cache, marks = self.pieces[lead], self.MARKS
        found = list(map(cache.get, pieces))
        missed = [i for i, c in enumerate(found) if c is None]
        if not missed:
            return found
        own = [pieces[i] for i in missed]
        heads = [w if w.isalpha() else x for w, x in zip([x.rstrip(marks) for x in own], own, strict=True)]
        tails = [x[len(w) :] for w, x in zip(heads, own, strict=True)]
        ends = self._learned([m for m in tails if m], "")
        words = self._learned(heads, lead)
        for i, w, m in zip(missed, heads, tails, strict=True):
            found[i] = words[w] + ends[m] if m else words[w]
        if len(cache) < self.p.cached_pieces:
            cache.update((pieces[i], found[i]) for i in missed)
        return found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each with the end id, end to end; and the number of ids of each text."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        cut = pc.split_pattern(column, " ")
        at = np.asarray(cut.offsets)
        coded = cut.values.dictionary_encode()
        distinct, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices).astype(np.int64)
        starts = at[:-1]  # pieces without a space before them
        firsts = [distinct[i] for i in index[starts].tolist()]
        odd = _no_letter_first(coded.dictionary, distinct)[index]
        odd[starts] = False
        whole = np.flatnonzero(np.add.reduceat(odd, starts)) if len(starts) else starts
        texts = [column[int(i)].as_py() for i in whole]
        codes = [*self._pieces(distinct, " "), *self._pieces(firsts, ""), *self._encoded(texts), np.array([self.p.end_id], f"<u{self.width}").tobytes()]
        # the order in which the codes stand: the first piece, the others, the end; or the whole text, the end
        n, k = len(column), np.diff(at)
        index[starts] = len(distinct) + np.arange(n)
        keep = np.ones(len(index), bool)
        for j, i in enumerate(whole.tolist()):
            keep[at[i] + 1 : at[i + 1]] = False
            index[at[i]], k[i] = len(distinct) + n + j, 1
        ends = np.cumsum(k)
        order = np.insert(index[keep], ends, len(codes) - 1)
        flat, size = np.frombuffer(b"".join(codes), f"<u{self.width}"), np.fromiter(map(len, codes), np.int64, len(codes)) // self.width
        before, many = np.cumsum(size) - size, size[order]
        ids = flat[np.repeat(before[order] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        return ids, np.add.reduceat(many, ends - k + np.arange(n)) if n else np.zeros(0, np.int64)


ENCODERS: dict[Params, Encoder] = {}  # of this Python worker
CACHES.append(ENCODERS)


def _encoder(p: Params) -> Encoder:
    if p not in ENCODERS:
        ENCODERS[p] = Encoder(p)
    return ENCODERS[p]


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard. doc_ids: ascending, null ones last; counts: ids of each document."""
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    head = HEAD.pack(MAGIC, ids.itemsize, len(counts), len(ids), len(counts) - len(known), least)
    return b"".join([head, encode(np.cumsum(counts)), encode((known - np.int64(least)).view(np.uint64)), ids.tobytes()])


class Shard:
    """Reads a shard: select() finds a document's ids, all_documents() goes through them."""

    def __init__(self, data: bytes):
        magic, self.width, self.n_docs, self.n_ids, self.nulls, self.least = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.ends = EliasFano(data, HEAD.size)
        self.known = EliasFano(data, self.ends.end)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, self.known.end)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        first, last = self.bounds(i)
        return self.ids[first:last]

    def doc_ids(self) -> list[int | None]:
        return [*(self.known.all().view(np.int64) + self.least).tolist(), *[None] * self.nulls]


def shards(spark: SparkSession, docs: DataFrame, p: Params) -> DataFrame:
    """The written table of shards."""
    bounded_batches(spark, p.batch_docs)
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    @task("token_output")
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, at, k, before = _encoder(p), TaskContext.get().partitionId(), 0, 0
        own: list[int | None] = []
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            data = pack(own, np.concatenate(counts), np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([k], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([data], pa.binary())], names=["range", "shard", "before", "n_ids", "n_docs", "data"])

        for b in batches:
            ids, many = enc.encode(b.column(1))
            own += b.column(0).to_pylist()
            parts.append(ids)
            counts.append(many)
            held += len(ids)
            if held >= p.shard_ids:
                yield shard()
                k, before, own, parts, counts, held = k + 1, before + held, [], [], [], 0
        if own:
            yield shard()

    return written(spark, dealt.mapInArrow(each, SHARDS), "token-shards")


def documents_of(spark: SparkSession, table: DataFrame) -> DataFrame:
    """From written shards: doc_id, start, n_tokens, ids_crc32, range and shard of each document."""
    bounded_batches(spark)
    sums = {r["range"]: r["n"] for r in table.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = {}, 0
    for k in sorted(sums):
        base[k], total = total, total + sums[k]

    @task("token_output")
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, s, before, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                own = Shard(data.as_buffer())
                ends = own.ends.all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                crc = [zlib.crc32(own.ids[i:j].astype("<u4").tobytes()) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(own.doc_ids(), pa.int64()), pa.array(starts + (base[k] + before), pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(n, k), pa.int32()), pa.array(np.full(n, s), pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "range", "shard"])

    return table.select("range", "shard", "before", "data").mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long, range int, shard int")


def default_params() -> Params:
    import public_tokenizers

    return Params(public_tokenizers.path("byte_bpe_50k.json"))


def query(spark: SparkSession, docs: DataFrame, p: Params | None = None) -> DataFrame:
    return documents_of(spark, shards(spark, docs, p or default_params()))


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """query() with smaller caches and batches, as other stages' workers stand beside this one's."""
    return query(spark, docs, replace(default_params(), cached_words=200_000, cached_pieces=60_000, batch_docs=400))
