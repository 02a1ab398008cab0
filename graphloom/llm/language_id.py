"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent in numpy.

A text is the mean of the embeddings of its hashed byte n-grams (lower case, words with one space between them). As mean and softmax layer are both linear, a
trained model folds to one row of logits per bucket, so scoring reads each byte once, in numpy, over whole texts.
Probabilities are calibrated by a temperature fitted on rows kept out of the descent. They sum to 1 over the learned languages
whatever the text is, so rejection goes by fit instead: the mean over a text's n-grams of the log-likelihood ratio that the
language which knows the n-gram best gives it. `reject_below` holds a bound for each class of lengths, taken from the median and
a low quantile of kept-out texts and of pieces of them, so that no single odd row moves it: what fits less is unlike every
learned language. With less than `least_kept` kept-out texts in all classes nothing but letterless texts is rejected.

Null, empty and letterless texts: `und` with score 0. Repeated rows get equal results. An empty table, or one without
labelled rows, gives `und` throughout. Extra columns are not read.
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, fresh, held_out, task, utf8

UNKNOWN = "und"
ORDERS = (2, 3, 4)
#: Any letter; marks, digits and symbols are none.
LETTER = r"\p{L}"
#: Bytes of words: ASCII letters in lower case, and all beyond ASCII.
WORDS = np.zeros(256, bool)
WORDS[97:123] = WORDS[128:] = True


@dataclass(frozen=True)
class Params:
    sample_per_language: int = 400  # labelled rows for the descent, at most; the bound of what is collected
    most_languages: int = 200
    buckets: int = 1 << 14
    dims: int = 16
    epochs: int = 8
    rate: float = 2.0
    seed: int = 7
    least_kept: int = 20  # kept-out texts of a class of lengths that a bound is taken from, at least
    low: float = 0.05  # quantile
    spread: float = 5.0  # so many times as far below the median as that quantile lies the bound


#: Upper ends of the classes of lengths, in n-grams.
CLASSES = np.array([48, 96, 192, 384, 1536, 6144])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # orders x buckets, languages: logits that one n-gram adds; the last column holds its fit
    bias: np.ndarray
    temperature: float
    reject_below: np.ndarray  # by class of lengths
    buckets: int


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes and offsets of the texts, every run of ASCII other than letters as one space: numbers and marks are in no language."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    letter = WORDS[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return np.where(letter, data, np.uint8(32))[keep], at[offsets]


def _bucket(data: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Buckets of all n-grams that start at data[i], i < len(data) - order + 1."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(n, np.uint32(order * 0x01000193))
    for k in range(order):
        h ^= data[k : k + n]
        h *= np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - (buckets.bit_length() - 1))


def _sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, buckets: int, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Sum of table rows and number of n-grams for each text; works on pieces of `step` bytes, however long a text is."""
    total, count = np.zeros((len(offsets) - 1, table.shape[1])), np.zeros(len(offsets) - 1)
    for k, order in enumerate(ORDERS):
        own = table[k * buckets : (k + 1) * buckets]
        ends = np.maximum(offsets[1:] - order + 1, offsets[:-1])
        count += ends - offsets[:-1]
        for s in range(0, max(len(data) - order + 1, 0), step):
            e = min(s + step, len(data) - order + 1)
            rows = np.take(own, _bucket(data[s : e + order - 1], order, buckets), axis=0)
            first, last = np.searchsorted(offsets, s, "right") - 1, np.searchsorted(offsets, e, "left")
            lo, hi = np.clip(offsets[first:last], s, e) - s, np.clip(ends[first:last], s, e) - s
            hi = np.maximum(hi, lo)
            running = np.zeros((e - s + 1, table.shape[1]))
            np.cumsum(rows, axis=0, out=running[1:])
            total[first:last] += running[hi] - running[lo]
    return total, count


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit_of(examples: list[tuple[np.ndarray, np.ndarray, int]], languages: int, buckets: int) -> np.ndarray:
    """Log-likelihood ratio of each n-gram, in the language that knows it best, to all buckets being alike; half a count is added to each."""
    known = np.full((len(ORDERS) * buckets, languages), 0.5)
    for ids, n, lang in examples:
        known[ids, lang] += n
    per_order = known.reshape(len(ORDERS), buckets, languages)
    return np.log(per_order / per_order.sum(axis=1, keepdims=True) * buckets).max(axis=2).reshape(-1)


def _bounds(count: np.ndarray, fit: np.ndarray, p: Params) -> np.ndarray:
    """The least fit of each class of lengths; a class with few texts takes the next shorter one's, as short texts vary more."""
    of, out = np.searchsorted(CLASSES, count), np.full(len(CLASSES) + 1, np.nan)
    for k in range(len(out)):
        own = fit[of == k]
        if len(own) >= p.least_kept:
            middle, low = np.quantile(own, [0.5, p.low])
            out[k] = middle - p.spread * (middle - low)
        elif k:
            out[k] = out[k - 1]
    some = out[~np.isnan(out)]
    return np.where(np.isnan(out), some[0] if len(some) else -np.inf, out)


def train(texts: list[str], langs: list[str], p: Params = Params()) -> Model:
    """Gradient descent over whole texts and over short pieces of them, so that short texts score well too."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((p.buckets * len(ORDERS), 1), np.float32), np.zeros(0), 1.0, np.full(len(CLASSES) + 1, -np.inf), p.buckets)
    rng = np.random.default_rng(p.seed)
    which = {x: i for i, x in enumerate(languages)}
    examples: list[tuple[str, int, int]] = []
    for i, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        kept = int(i % 5 == 0)
        examples.append((t, which[lang], kept))
        for _ in range(2):
            width = int(rng.integers(8, 160))
            at = int(rng.integers(0, max(1, len(t) - width + 1)))
            examples.append((t[at : at + width], which[lang], kept * 2))
    features, sizes = [], []
    data, offsets = _lowered(pa.array([x[0] for x in examples], pa.large_string()))
    for i in range(len(examples)):
        own = data[offsets[i] : offsets[i + 1]]
        ids = np.concatenate([_bucket(own, o, p.buckets).astype(np.int64) + k * p.buckets for k, o in enumerate(ORDERS)])
        ids, n = np.unique(ids, return_counts=True)
        features.append((ids, n / max(1, n.sum())))
        sizes.append(int(n.sum()))
    emb = rng.normal(0, 0.1, (p.buckets * len(ORDERS), p.dims))
    out, bias = rng.normal(0, 0.1, (p.dims, len(languages))), np.zeros(len(languages))
    learn = [i for i, x in enumerate(examples) if not x[2] and len(features[i][0])]
    steps, done = max(1, p.epochs * len(learn)), 0
    for _ in range(p.epochs):
        for i in rng.permutation(learn):
            ids, f = features[i]
            rate = p.rate * (1 - done / steps)
            x = f @ emb[ids]
            g = _softmax((x @ out + bias)[None])[0]
            g[examples[i][1]] -= 1
            back = out @ g
            out -= rate * np.outer(x, g)
            bias -= 0.1 * rate * g
            emb[ids] -= rate * f[:, None] * back[None]
            done += 1
    table = (emb @ out).astype(np.float32)
    rest = [i for i, x in enumerate(examples) if x[2] and len(features[i][0])]
    temperature, below = 1.0, np.full(len(CLASSES) + 1, -np.inf)
    if rest:
        z = np.array([features[i][1] @ table[features[i][0]] + bias for i in rest])
        y = np.array([examples[i][1] for i in rest])
        temperature = float(min(np.geomspace(0.2, 10, 60), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()))
    whole = [i for i in learn if i % 3 == 0]
    fit = _fit_of([(features[i][0], features[i][1] * sizes[i], examples[i][1]) for i in whole], len(languages), p.buckets).astype(np.float32)
    table = np.hstack([table, fit[:, None]])
    kept = [examples[i][0] for i in rest if examples[i][2] == 1]
    kept += [t[at : at + width] for t in kept for width in (16, 32, 64, 128, 512, 2048) if len(t) > width for at in (int(rng.integers(0, len(t) - width + 1)),)]
    if kept:
        data, offsets = _lowered(pa.array(kept, pa.large_string()))
        total, count = _sums(data, offsets, fit[:, None], p.buckets)
        some = (count > 0) & pc.match_substring_regex(pa.array(kept, pa.large_string()), LETTER).to_numpy(zero_copy_only=False)
        below = _bounds(count[some], total[some, 0] / count[some], p)
    return Model(languages, table, bias, temperature, below, p.buckets)


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and calibrated probability of each text, and whether it is unlike every language."""
    letters = pc.fill_null(pc.match_substring_regex(column, LETTER), False).to_numpy(zero_copy_only=False)
    if not model.languages:
        return [UNKNOWN] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
    data, offsets = _lowered(column)
    total, count = _sums(data, offsets, model.table, model.buckets)
    mean = total / np.maximum(count, 1)[:, None]
    prob = _softmax((mean[:, :-1] + model.bias) / model.temperature)
    best = prob.argmax(axis=1)
    away = ~letters | ((count > 0) & (mean[:, -1] < model.reject_below[np.searchsorted(CLASSES, count)]))
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, prob[np.arange(len(best)), best], 0.0), away


def fit(docs: DataFrame, p: Params = Params()) -> Model:
    """Trains on at most `sample_per_language` rows of each language, picked by a hash of the row over the whole table. One task
    gathers that sample and runs the descent, so the driver gets the model alone."""
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("text", "lang", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)).alias("at"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.most_languages).collect()
    if not counts:
        return train([], [], p)
    upto = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, p.sample_per_language / r["count"]) * (1 << 20))))])

    @task("language_id")
    def learn(batches):
        rows, seen = [], Counter()
        for x in sorted({x for b in batches for x in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True)}):
            seen[x[1]] += 1
            if seen[x[1]] <= p.sample_per_language:
                rows.append(x)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[2] for r in rows], [r[1] for r in rows], p))], pa.binary())], names=["model"])

    sample = known.where(F.col("at") < upto[F.col("lang")]).repartition(1)
    made = sample.mapInArrow(learn, "model binary").head()
    return pickle.loads(made["model"]) if made else train([], [], p)


def classify(spark: SparkSession, docs: DataFrame, model: Model, columns: list[str], own: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """`columns` of docs, then the prediction, its probability and whether it is rejected, under the names `own`."""
    bounded_batches(spark)
    read = docs.select(*columns, *([] if "text" in columns else ["text"]))
    names = [*columns, *own]
    schema = ", ".join(f"`{c}` {t}" for c, t in [*((c, t) for c, t in read.dtypes if c in columns), *zip(own, ("string", "double", "boolean"), strict=True)])

    @task("language_id")
    def each(batches):
        for b in batches:
            lang, score, away = predict(model, b.column(b.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in columns), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(away, pa.bool_())], names=names)

    return read.mapInArrow(each, schema)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = classify(spark, docs, fit(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, with their own columns."""
    own = fresh(docs, 3)
    return classify(spark, docs, fit(docs), docs.columns, tuple(own)).where(~F.col(own[2])).select(*docs.columns)
