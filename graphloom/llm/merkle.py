"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

Leaves are runs of bytes that end before a word once a word's hash has two zero bits, and at the end of each paragraph (line);
together they cover the text. A paragraph's hash is that of its leaves' hashes, a section is a run of paragraphs that ends with
one whose hash has two zero bits, and the root is SHA-256 of the sections' hashes and the text's length. Cuts depend on
the text near them only, so an edit changes the leaves it touches and the branch above them; everything else stays equal.

A leaf's hash is BLAKE2b-128 of its bytes; a paragraph's and a section's are BLAKE2b-128 of their children's hashes in order, each
level under a name of its own. So equal roots mean equal texts as far as BLAKE2b and SHA-256 hold.

A fingerprint is a string: the root in hex, a colon, base64 of the levels (ends and 32-bit heads of the hashes). likeness() and
differing() compare level by level and look only into branches that differ.

The query pairs each document with the next one by doc_id. Documents are cut into buckets by doc_id quantiles taken over all
rows, each bucket is read in order in one task, and the last document of a bucket meets the first of the next bucket in a
small join. Only the text of two documents a bucket moves twice. Rows with a null doc_id come last, by a hash of their text.

Null and empty texts have no leaf, all the same fingerprint, and likeness 1 to each other. Repeated rows follow each other; rows that
share an id share a bucket. A
single row is its own next document. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.bytewords import NOT_SPACE, pieces, span_hashes, spans
from graphloom.llm.common import bounded_batches, partitions, task

CUT = np.uint64(3)  # a word or paragraph ends its group if these bits are zero


WIDTH = 16  # bytes of a node's hash


def _nodes(data: bytes, first: np.ndarray, last: np.ndarray, level: bytes) -> tuple[bytes, np.ndarray]:
    """Hashes of all data[first:last], end to end, and as rows of four 32-bit numbers."""
    view = memoryview(data)
    out = b"".join([hashlib.blake2b(view[i:j], digest_size=WIDTH, person=level).digest() for i, j in zip(first.tolist(), last.tolist(), strict=True)])
    return out, np.frombuffer(out, "<u4").reshape(-1, WIDTH // 4)


def trees(column: pa.Array) -> Iterator[tuple[str, list[np.ndarray]]]:
    """Fingerprint and levels (ends of sections in paragraphs, of paragraphs in leaves; hashes of each level) of each text."""
    for _, data, offsets in pieces(column, lower=False):
        starts, ends, at = spans(data, offsets, NOT_SPACE)
        word = span_hashes(data, starts, ends)
        lines = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 10, out=lines[1:])
        line = lines[starts]
        new_text = np.zeros(len(starts) + 1, bool)
        new_text[at] = True
        # a leaf begins at a text's start, at a line's first word and behind a word that cuts
        begins = new_text[:-1].copy()
        begins[1:] |= (line[1:] != line[:-1]) | ((word[:-1] & CUT) == 0)
        new_line = new_text[:-1].copy()
        new_line[1:] |= line[1:] != line[:-1]
        leaf_word = np.flatnonzero(begins)
        leaf_at = starts[leaf_word]
        of_leaf = np.searchsorted(leaf_word, at)  # leaves before each text
        # texts of white space alone have one leaf
        blank = np.flatnonzero((np.diff(at) == 0) & (np.diff(offsets) > 0))
        for i in blank[::-1].tolist():
            leaf_at = np.insert(leaf_at, of_leaf[i], offsets[i])
            leaf_word = np.insert(leaf_word, of_leaf[i], -1)
        if len(blank):
            extra = np.zeros(len(offsets), np.int64)
            extra[blank + 1] = 1
            of_leaf = of_leaf + np.cumsum(extra)
        has = np.flatnonzero(np.diff(of_leaf) > 0)
        leaf_at = leaf_at.copy()
        leaf_at[of_leaf[has]] = offsets[has]
        leaf_end = np.append(leaf_at[1:], offsets[-1]) if len(leaf_at) else leaf_at
        leaf_end[of_leaf[has + 1] - 1] = offsets[has + 1]
        leaf, leaves = _nodes(data.tobytes(), leaf_at, leaf_end, b"leaf")
        par_first = np.zeros(len(leaves), bool)
        par_first[of_leaf[has]] = True
        real = leaf_word >= 0
        par_first[real] |= new_line[leaf_word[real]]
        pars = np.flatnonzero(par_first)
        par_end = np.append(pars[1:], len(leaves)) if len(pars) else pars
        par, paragraphs = _nodes(leaf, pars * WIDTH, par_end * WIDTH, b"paragraph")
        of_par = np.searchsorted(pars, of_leaf)
        sec_first = np.zeros(len(pars), bool)
        sec_first[1:] = (paragraphs[:-1, 1] & 3) == 0
        sec_first[of_par[has]] = True
        secs = np.flatnonzero(sec_first)
        sec_end = np.append(secs[1:], len(pars)) if len(secs) else secs
        sec, sections = _nodes(par, secs * WIDTH, sec_end * WIDTH, b"section")
        of_sec = np.searchsorted(secs, of_par)
        size = np.diff(offsets)
        for i in range(len(offsets) - 1):
            s, t, p, q, a, b = of_sec[i], of_sec[i + 1], of_par[i], of_par[i + 1], of_leaf[i], of_leaf[i + 1]
            levels = [(sec_end[s:t] - p).astype("<u4"), (par_end[p:q] - a).astype("<u4"), sections[s:t, 0].copy(), paragraphs[p:q, 0].copy(), leaves[a:b, 0].copy()]
            root = hashlib.sha256(sec[s * WIDTH : t * WIDTH] + int(size[i]).to_bytes(8, "little")).hexdigest()[:32]
            body = np.array([t - s, q - p], "<u4").tobytes() + b"".join(x.tobytes() for x in levels)
            yield f"{root}:{base64.b64encode(body).decode()}", levels


def parse(fingerprint: str) -> tuple[str, list[np.ndarray]]:
    root, _, body = fingerprint.partition(":")
    x = np.frombuffer(base64.b64decode(body), "<u4")
    s, p = int(x[0]), int(x[1])
    cut = np.cumsum([2, s, p, s, p])
    return root, [x[i:j] for i, j in zip(cut, [*cut[1:], len(x)], strict=True)]


def differing(a: list[np.ndarray], b: list[np.ndarray]) -> list[int]:
    """Leaves of a that b doesn't have, looked for only under sections and paragraphs that b doesn't have."""
    sections, paragraphs, leaves = Counter(b[2].tolist()), Counter(b[3].tolist()), Counter(b[4].tolist())
    spent_p, spent_l, open_p, out = Counter(), Counter(), [], []

    def leaves_of(tree: list[np.ndarray], p: int) -> range:
        return range(int(tree[1][p - 1]) if p else 0, int(tree[1][p]))

    for k, h in enumerate(a[2].tolist()):
        own = range(int(a[0][k - 1]) if k else 0, int(a[0][k]))
        if sections[h] > 0:
            sections[h] -= 1
            for p in own:
                spent_p[int(a[3][p])] += 1
                spent_l.update(a[4][x] for x in leaves_of(a, p))
        else:
            open_p += own
    paragraphs.subtract(spent_p)
    rest = []
    for p in open_p:
        h = int(a[3][p])
        if paragraphs[h] > 0:
            paragraphs[h] -= 1
            spent_l.update(a[4][x] for x in leaves_of(a, p))
        else:
            rest.append(p)
    leaves.subtract({int(k): v for k, v in spent_l.items()})
    for p in rest:
        for x in leaves_of(a, p):
            h = int(a[4][x])
            if leaves[h] > 0:
                leaves[h] -= 1
            else:
                out.append(x)
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray], equal: bool = False) -> float:
    """Twice the leaves in common over all leaves; 1 where the roots are equal."""
    x, y = a[4], b[4]
    if equal:
        return 1.0
    if not len(x) or not len(y):
        return 1.0 if len(x) == len(y) else 0.0
    left = Counter(x.tolist())
    common = sum(min(n, left[h]) for h, n in Counter(y.tolist()).items() if h in left)
    return 2 * common / (len(x) + len(y))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], following: list[str], doc_id: pa.DataType) -> pa.RecordBatch:
    edited = [_edited(t, n) for t, n in zip(texts, following, strict=True)]
    own, other = list(trees(pa.array(texts, pa.large_string()))), list(trees(pa.array(edited, pa.large_string())))
    # a next text is mostly the next row's own
    after, new = [], [n for t, n in zip([*texts[1:], None], following, strict=True) if t is not n]
    fresh = iter(trees(pa.array(new, pa.large_string())))
    for i, n in enumerate(following):
        after.append(own[i + 1] if i + 1 < len(texts) and texts[i + 1] is n else next(fresh))
    alike = lambda a, b: likeness(a[1], b[1], a[0][:32] == b[0][:32])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, doc_id), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([f for f, _ in own], pa.string()), pa.array([f for f, _ in other], pa.string()),
            pa.array([alike(a, b) for a, b in zip(own, other, strict=True)], pa.float64()),
            pa.array([alike(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
        ],
        names=["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")]],
    )


def _below(cuts: list[int], x: Column) -> Column:
    """How many of the ascending cuts are less than x, by bisection."""
    if not cuts:
        return F.lit(0)
    table = F.lit(cuts).cast("array<bigint>")
    steps = F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) < x, at + step).otherwise(at))


def fingerprints(spark: SparkSession, docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """A row for each document: itself, its edited text, and how alike they and the next document are."""
    bounded_batches(spark)
    n = n_buckets or partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.where(F.col("doc_id").isNotNull()).agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).head()[0] or []
    cuts = sorted(set(cuts))
    h = F.shiftrightunsigned(F.xxhash64("text"), 2)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1) + F.floor(h / (2.0**62 / n)).cast("int")).otherwise(_below(cuts, F.col("doc_id")))
    rows = rows.select(bucket.cast("int").alias("bucket"), "doc_id", h.alias("h"), "text")
    order = ["bucket", F.col("doc_id").asc_nulls_last(), "h"]
    # ids at both ends of each bucket: no more rows than buckets
    ends = rows.select("bucket", F.coalesce("doc_id", "h").alias("key")).groupBy("bucket").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    ends = {r["bucket"]: (r["least"], r["most"]) for r in ends.collect()}
    if not ends:
        return spark.createDataFrame([], f"doc_id long, {COLUMNS}")
    used = sorted(ends)
    after = dict(zip(used, [*used[1:], used[0]], strict=True))
    kind = pa.int64()

    @task("merkle")
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All but the last document of each bucket."""
        bucket, ids, texts = None, [], []
        for b in batches:
            for k, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if k != bucket:
                    if len(ids) > 1:
                        yield _rows(ids[:-1], texts[:-1], texts[1:], kind)
                    bucket, ids, texts = k, [], []
                ids.append(i)
                texts.append(t)
            if len(ids) > 1:
                yield _rows(ids[:-1], texts[:-1], texts[1:], kind)
                ids, texts = ids[-1:], texts[-1:]

    @task("merkle")
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), kind)

    schema = f"doc_id long, {COLUMNS}"
    most = rows.repartitionByRange(n, "bucket").sortWithinPartitions(*order).mapInArrow(inner, schema)
    edge = spark.createDataFrame([(b, *ends[b], after[b]) for b in used], "b int, least long, most long, after int")
    key = F.coalesce("doc_id", "h")
    at_ends = rows.join(F.broadcast(edge), (F.col("bucket") == F.col("b")) & ((key == F.col("least")) | (key == F.col("most"))))  # edge has a row a bucket
    ranked = lambda way: F.row_number().over(Window.partitionBy("bucket").orderBy(*way))
    up, down = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()], [F.col("doc_id").desc_nulls_first(), F.col("h").desc()]
    at_ends = at_ends.withColumn("up", ranked(up)).withColumn("down", ranked(down))
    firsts = at_ends.where("up = 1").select(F.col("bucket").alias("f"), F.col("text").alias("following"))
    lasts = at_ends.where("down = 1").select("doc_id", "text", "after")
    return most.unionByName(lasts.join(firsts, F.col("after") == F.col("f")).select("doc_id", "text", "following").mapInArrow(outer, schema))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return fingerprints(spark, docs)
