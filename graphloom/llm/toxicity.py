"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals add up to document scores.

Labels are per document, so tokens are labelled first: a word is a toxic token in a toxic document if most documents that hold
it are toxic, and so many more than of all documents that no word of the sample would show it by chance (likelihood ratio). The field has two states; a token's features are its word (of a
vocabulary learned from the sample, by 64-bit hash, else `unknown`), its length and whether it is in capitals; transitions
join neighbours. It is trained by gradient ascent on the conditional likelihood. Forward-backward gives each token's
marginal. A document's score is a logistic function of the expected number of toxic tokens, fitted on the same rows.

A document is one chain, however long: runs of `chain` words are passed side by side, once to a 2 x 2 matrix each, and once more
from the messages that these matrices carry over their ends, so the marginals are those of the whole text. Training chains are
runs of at most `chain` words. The query gives the offsets of each run of words with a marginal of `least_span` or more, in code points.

Null and empty texts have no tokens and score what the fitted function gives for 0. Without labelled rows the score is 0.
Repeated rows score alike. Labels that repeat for a document count as toxic if one is. Extra columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bytewords import LETTERS, PIECE, span_hashes, spans
from graphloom.llm.common import bounded_batches, held_out, mixed, runs, task, utf8


@dataclass(frozen=True)
class Params:
    most_toxic: int = 700  # labelled documents of each kind that are collected, at most
    most_clean: int = 1400
    vocabulary: int = 4000  # of words and of starts of each length, beside toxic ones
    least_rate: float = 0.6  # of toxic documents among those with a toxic word
    least_surprise: float = 3.0  # log likelihood ratio of that rate beyond the log of the number of words
    chain: int = 64
    least_span: float = 0.5
    steps: int = 80
    least_marginal: float = 0.2  # what adds to a document's score is the marginal above this
    penalty: float = 1e-3


#: Bytes of the starts of words that are features; a word is its own start if it isn't longer.
STARTS = (4, 5, 6, 8)


@dataclass
class Model:
    words: list[np.ndarray]  # ascending hashes: of words, and of starts of each length
    weights: list[np.ndarray]  # of each of them, then of an unknown one: toxic over clean
    other: np.ndarray  # of capitals, short, long, constant
    transitions: np.ndarray  # 2 x 2
    logistic: np.ndarray  # constant, share of one expected token, log of more
    chain: int
    least_marginal: float
    least_span: float


def cased(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number of the first text, bytes in lower case, bytes as they were (if as many, else the lower ones) and offsets of each
    piece. Lower case is letter for letter, so code points keep their places."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    data, offsets = utf8(pc.utf8_lower(column))
    was, before = utf8(column)
    for i, j in runs(offsets, PIECE):
        low, own = data[offsets[i] : offsets[j]], was[before[i] : before[j]]
        yield i, low, own if len(own) == len(low) else low, offsets[i : j + 1] - offsets[i]


class Tokens:
    """Words of letters of a piece of texts."""

    def __init__(self, low: np.ndarray, was: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.at = spans(low, offsets, LETTERS)
        self.hash = [span_hashes(low, self.starts, self.ends), *(span_hashes(low, self.starts, np.minimum(self.starts + k, self.ends)) for k in STARTS)]
        letters, changed = np.zeros(len(low) + 1, np.int64), np.zeros(len(low) + 1, np.int64)
        np.cumsum((low & 0xC0) != 0x80, out=letters[1:])
        np.cumsum(low != was, out=changed[1:])
        size = letters[self.ends] - letters[self.starts]
        caps = (changed[self.ends] - changed[self.starts] >= size) & (size > 1)
        self.other = np.stack([caps, size <= 3, size >= 12, np.ones(len(size), bool)], axis=1)

    def chains(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """First token and number of tokens of each chain."""
        n = np.diff(self.at)
        per = -(-n // most)
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        first = np.repeat(self.at[:-1], per) + k * most
        return first, np.minimum(np.repeat(n, per) - k * most, most)


def _ids(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, len(words))


def _side_by_side(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The order of chains by length, their first tokens in that order, and how many are longer than t for each t."""
    order = np.argsort(-size, kind="stable")
    size = size[order]
    longest = int(size[0]) if len(size) else 0
    return order, first[order], [int(np.searchsorted(-size, -t, "left")) for t in range(longest)]


def forward_backward(emission: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of the toxic state for each token, expected transitions, log of the partition summed over chains.

    emission: score of toxic over clean. Chains of any length go side by side, the longest first. before: for each chain what the
    states of its first token weigh by what stands before it; after: those of its last one by what stands behind; 1 where not given.
    """
    order, first, alive = _side_by_side(first, size)
    t00, t01, t10, t11 = np.exp(trans).ravel()
    e = np.exp(np.clip(emission, -30, 30))
    a0, a1 = np.empty(len(emission)), np.empty(len(emission))  # scaled forward values
    total = 0.0
    for t, n in enumerate(alive):
        at = first[:n] + t
        x1 = e[at]
        if t:
            p0, p1 = a0[at - 1], a1[at - 1]
            x0, x1 = p0 * t00 + p1 * t10, (p0 * t01 + p1 * t11) * x1
        elif before is not None:
            x0, x1 = before[order, 0][:n], before[order, 1][:n] * x1
        else:
            x0 = np.ones(n)
        s = x0 + x1
        a0[at], a1[at] = x0 / s, x1 / s
        total += float(np.log(s).sum())
    m = np.empty(len(emission))
    b0, b1 = (np.ones(len(first)), np.ones(len(first))) if after is None else (after[order, 0], after[order, 1])
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        x0, x1 = a0[at] * b0[:n], a1[at] * b1[:n]
        m[at] = x1 / (x0 + x1)
        if t:
            y0, y1 = b0[:n], e[at] * b1[:n]
            p0, p1 = a0[at - 1], a1[at - 1]
            four = np.stack([p0 * t00 * y0, p0 * t01 * y1, p1 * t10 * y0, p1 * t11 * y1])
            pairs += (four / four.sum(axis=0)).sum(axis=1).reshape(2, 2)
            n0, n1 = t00 * y0 + t01 * y1, t10 * y0 + t11 * y1
            s = n0 + n1
            b0[:n], b1[:n] = n0 / s, n1 / s
    return m, pairs, total


def _messages(emission: np.ndarray, first: np.ndarray, size: np.ndarray, per: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes to each run of a document from before it and from behind it. per: runs of each document, in order.

    A run's matrix maps the weights of its first token's states to those of its last one's, so a document's messages are products of
    as many matrices as it has runs; documents go side by side.
    """
    order, start, alive = _side_by_side(first, size)
    move = np.exp(trans)
    e = np.exp(np.clip(emission, -30, 30))
    run = np.zeros((len(first), 2, 2))
    for t, n in enumerate(alive):
        own = e[start[:n] + t]
        if t:
            x = run[:n] @ move
            x[:, :, 1] *= own[:, None]
            run[:n] = x / x.sum(axis=(1, 2), keepdims=True)
        else:
            run[:n, 0, 0], run[:n, 1, 1] = 1, own
    matrix = np.empty_like(run)
    matrix[order] = run
    before, after = np.ones((len(first), 2)), np.ones((len(first), 2))
    begin = np.cumsum(per) - per
    _, begin, alive = _side_by_side(begin, per)
    for k in range(1, len(alive)):
        at = begin[: alive[k]] + k
        x = (before[at - 1][:, None, :] @ matrix[at - 1])[:, 0] @ move
        before[at] = x / x.sum(axis=1, keepdims=True)
    for k in range(len(alive) - 1, 0, -1):
        at = begin[: alive[k]] + k
        x = (matrix[at] @ after[at][:, :, None])[:, :, 0] @ move.T
        after[at - 1] = x / x.sum(axis=1, keepdims=True)
    return before, after


def chain_marginals(emission: np.ndarray, at: np.ndarray, run: int, trans: np.ndarray) -> np.ndarray:
    """Marginals of each document's tokens emission[at[i]:at[i + 1]] as one chain, worked out in runs of so many tokens."""
    n = np.diff(at)
    per = -(-n // run)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    first, size = np.repeat(at[:-1], per) + k * run, np.minimum(np.repeat(n, per) - k * run, run)
    if not len(first) or per.max() < 2:
        return forward_backward(emission, first, size, trans)[0]
    return forward_backward(emission, first, size, trans, *_messages(emission, first, size, per, trans))[0]


def marginals(model: Model, tokens: Tokens) -> np.ndarray:
    emission = tokens.other @ model.other
    for h, words, weights in zip(tokens.hash, model.words, model.weights, strict=True):
        emission += weights[_ids(h, words)]
    return chain_marginals(emission, tokens.at, model.chain, model.transitions)


def _features(expected: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(expected)), 1 - np.exp(-2 * expected), np.log1p(expected)], axis=1)


def train(texts: list[str], toxic: list[int], weight: list[float], p: Params = Params()) -> Model | None:
    """toxic: 1 or 0; weight: how many labelled documents each collected one stands for."""
    if not texts:
        return None
    y, w = np.array(toxic), np.array(weight, float)
    parts, docs = [], []
    for first, low, was, offsets in cased(pa.array(texts, pa.large_string())):
        parts.append(Tokens(low, was, offsets))
        docs.append(np.repeat(np.arange(len(offsets) - 1) + first, np.diff(parts[-1].at)))
    doc = np.concatenate(docs)
    other = np.concatenate([t.other for t in parts]).astype(float)
    base_rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    token_label, vocabularies, ids = np.zeros(len(doc), bool), [], []
    full = np.concatenate([t.hash[0] for t in parts])
    around = mixed(np.roll(full, 1) * np.uint64(0xD6E8FEB86659FD93) + np.roll(full, -1))
    for k in range(len(STARTS) + 1):
        key = np.concatenate([t.hash[k] for t in parts])
        kinds, of = np.unique(key, return_inverse=True)
        # a word counts once for each context of its first occurrence in a document: copies of a text are one witness
        _, at = np.unique(of * len(texts) + doc, return_index=True)
        _, once = np.unique(mixed(around[at] + key[at]), return_index=True)
        at = at[once]
        n = np.bincount(of[at], minlength=len(kinds))
        rate = np.bincount(of[at], weights=y[doc[at]], minlength=len(kinds)) / np.maximum(n, 1)
        kl = rate * np.log(np.maximum(rate, 1e-12) / base_rate) + (1 - rate) * np.log(np.maximum(1 - rate, 1e-12) / (1 - base_rate))
        marked = (rate >= p.least_rate) & (rate > base_rate) & (n * kl >= np.log(max(len(kinds), 1)) + p.least_surprise)
        token_label |= marked[of] & (y[doc] == 1)
        rank = np.argsort(-(n + marked * len(texts)), kind="stable")[: p.vocabulary + int(marked.sum())]
        vocabularies.append(kinds[np.sort(rank[n[rank] >= 2])])
        ids.append(_ids(key, vocabularies[-1]).astype(np.int32))
    token_label = token_label.astype(float)
    base, chains = 0, []
    for t in parts:
        f, s = t.chains(p.chain)
        chains.append((f + base, s))
        base += len(t.starts)
    first, size = np.concatenate([c[0] for c in chains]), np.concatenate([c[1] for c in chains])
    # chains with marked tokens, and so many others
    run = np.concatenate([[0], np.cumsum(token_label)])
    has = run[first + size] > run[first]
    rest = np.flatnonzero(~has)
    rest = np.random.default_rng(11).permutation(rest)[: max(2000, 3 * int(has.sum()))]
    use = np.concatenate([np.flatnonzero(has), rest])
    first, size = first[use], size[use]
    at = np.repeat(first, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    ids, other, lab = [x[at] for x in ids], other[at], token_label[at]
    first = np.cumsum(size) - size
    inner = np.ones(len(at), bool)
    inner[first] = False
    now, before = lab[inner].astype(int), lab[np.flatnonzero(inner) - 1].astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (before, now), 1)
    weights = [np.zeros(len(v) + 1) for v in vocabularies]
    extra, trans = np.zeros(other.shape[1]), np.zeros((2, 2))
    scale = max(1, len(first))
    values = [*weights, extra, trans]
    squares = [np.full_like(x, 1e-8) for x in values]
    for _ in range(p.steps):
        m, pairs, _z = forward_backward(sum(w[i] for w, i in zip(weights, ids, strict=True)) + other @ extra, first, size, trans)
        d = (lab - m) / scale
        grads = [*(np.bincount(i, weights=d, minlength=len(w)) - p.penalty * w / scale for w, i in zip(weights, ids, strict=True)), other.T @ d, (seen - pairs) / scale]
        for x, g, q in zip(values, grads, squares, strict=True):
            q += g * g
            x += 0.5 * g / np.sqrt(q)
    model = Model(vocabularies, weights, extra, trans, np.zeros(3), p.chain, p.least_marginal, p.least_span)
    expected = np.concatenate([_expected(model, t) for t in parts])
    x, b = _features(expected), np.zeros(3)
    for _ in range(50):  # Newton steps of a weighted logistic regression with a small ridge
        q = 1 / (1 + np.exp(-x @ b))
        h = (x * (w * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        b += np.linalg.solve(h, x.T @ (w * (y - q)) - 0.05 * b)
    model.logistic = b
    return model


def _expected(model: Model, t: Tokens, m: np.ndarray | None = None) -> np.ndarray:
    """Expected toxic tokens of each text. Tokens far from toxic don't add up, so long clean texts stay clean."""
    m = marginals(model, t) if m is None else m
    run = np.concatenate([[0.0], np.cumsum(np.maximum(m - model.least_marginal, 0) / (1 - model.least_marginal))])
    return run[t.at[1:]] - run[t.at[:-1]]


def tagged(model: Model | None, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Score of each text, and its toxic spans: first and last code point (exclusive) and highest marginal of each run of toxic tokens."""
    out, found = np.zeros(len(column)), [[] for _ in range(len(column))]
    for first, low, was, offsets in cased(column) if model is not None else ():
        t = Tokens(low, was, offsets)
        m = marginals(model, t)
        out[first : first + len(offsets) - 1] = 1 / (1 + np.exp(-_features(_expected(model, t, m)) @ model.logistic))
        toxic = np.flatnonzero(m >= model.least_span)
        if not len(toxic):
            continue
        chars = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
        text = np.searchsorted(t.at, toxic, "right") - 1
        new = np.append(True, (np.diff(toxic) > 1) | (np.diff(text) > 0))
        a, b = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(toxic)) - 1
        base = chars[offsets[text[a]]]
        best = np.maximum.reduceat(m[toxic], a)
        for i, x, y, s in zip(text[a].tolist(), (chars[t.starts[toxic[a]]] - base).tolist(), (chars[t.ends[toxic[b]]] - base).tolist(), best.tolist(), strict=True):
            found[first + i].append((x, y, s))
    return out, found


def scores(model: Model | None, column: pa.Array) -> np.ndarray:
    return tagged(model, column)[0]


def toxic_spans(model: Model, text: str) -> list[tuple[int, int, float]]:
    return tagged(model, pa.array([text], pa.large_string()))[1][0]


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model | None:
    """Trains on a bounded number of labelled rows of each kind, picked by a hash over all of them."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return None
    share = {k: min(1.0, most / counts[k]) for k, most in ((1, p.most_toxic), (0, p.most_clean)) if counts.get(k)}
    cut = F.when(F.col("toxic") == 1, int(share.get(1, 0) * (1 << 24))).otherwise(int(share.get(0, 0) * (1 << 24)))
    picked = known.where(F.col("at") < cut)  # bounded by most_toxic and most_clean, so it is sent to all
    bounded_batches(docs.sparkSession)

    @task("toxicity")
    def learn(batches):
        rows = sorted({x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        model = train([r[2] for r in rows], [r[3] for r in rows], [1 / share[r[3]] for r in rows], p)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # rows that repeat with id and text are one, so the sample keeps its bound; one task gathers it and trains
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.first("at").alias("at"), F.max("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = sample.select("at", F.col("doc_id").cast("string"), "text", "toxic").repartition(1)
    made = sample.mapInArrow(learn, "model binary").head()
    return pickle.loads(made["model"]) if made else None


def score(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, span_starts and span_ends (code points; ends exclusive) of each row of docs."""
    bounded_batches(spark)

    @task("toxicity")
    def each(batches):
        for b in batches:
            own, found = tagged(model, b.column(1))
            ends = [pa.array([[x[k] for x in f] for f in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.float64()), *ends], names=["doc_id", "score", "span_starts", "span_ends"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, span_starts array<long>, span_ends array<long>")


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(spark, docs, fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "span_starts", "span_ends")
