"""The pipeline's stages: users' columns come back as they were, and what each does equals its operator's own result."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontamination, language_id, near_duplicates, source_mix, token_output
from graphloom.llm.common import documents

CLASHING = ("score", "lang_pred", "rejected", "_key", "_gone", "_first", "_row", "_bad", "_d", "_s", "_n", "_size", "_copies", "_copy", "_own_0", "_own_1", "_own_2", "h", "shard", "whole", "last", "size")


@pytest.fixture(scope="module")
def docs(spark, small):
    return documents(spark, small)


@pytest.fixture(scope="module")
def benchmark(spark, small):
    return spark.read.parquet(f"{small}/benchmark.parquet")


def test_users_columns_come_back(spark, docs, benchmark):
    wide = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in CLASHING})
    for stage in (language_id.stage, near_duplicates.stage, source_mix.stage, lambda s, d: decontamination.stage(s, d, benchmark)):
        got = stage(spark, wide)
        assert got.columns == wide.columns
        rows = got.collect()
        assert rows and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in CLASHING)
        assert {r["doc_id"]: r["text"] for r in rows}.items() <= {r["doc_id"]: r["text"] for r in docs.collect()}.items()


def test_language_stage_drops_what_is_rejected(spark, docs):
    odd = spark.createDataFrame([(10**6, "東京は日本の首都であり、世界でも有数の大都市である。人口は多い。" * 3, "en", "x", 1), (10**6 + 1, "Все люди рождаются свободными и равными в своём достоинстве и правах. " * 3, "en", "x", 1), (10**6 + 2, "xkq vbzw qqjf zxvk wqpz jjkx vvbq zkwx qxzj kvwq " * 6, "en", "x", 1), (10**6 + 3, "fjdksla; fjdksl a;fjdk slaj fkdlsa; jfkdl; sajfk dlsa" * 5, "en", "x", 1)], docs.schema)
    kept = {r["doc_id"] for r in language_id.stage(spark, docs.unionByName(odd)).select("doc_id").collect()}
    clean = {r["doc_id"] for r in docs.where("length(text) > 200").select("doc_id").collect()}
    assert not kept & set(range(10**6, 10**6 + 4)) and len(clean & kept) >= 0.98 * len(clean)


def test_near_duplicate_stage_keeps_the_least_of_each_group(spark, docs):
    component = {r["doc_id"]: r["component_id"] for r in near_duplicates.query(spark, docs).collect()}
    kept = {r["doc_id"] for r in near_duplicates.stage(spark, docs).select("doc_id").collect()}
    assert kept == {k for k, c in component.items() if k == c}


def test_decontamination_stage_drops_what_is_found(spark, docs, benchmark):
    bad = {r["doc_id"] for r in decontamination.query(spark, docs, benchmark).collect()}
    kept = {r["doc_id"] for r in decontamination.stage(spark, docs, benchmark).select("doc_id").collect()}
    assert bad and kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - bad


@pytest.mark.parametrize("p", [source_mix.Params(), source_mix.Params(shard_docs=8, block_words=16)])
def test_mix_stage_takes_what_the_mix_says(spark, docs, p):
    want = Counter()
    for r in source_mix.mix(spark, docs, p).collect():
        if r["size"]:
            want[r["doc_id"]] = int(np.floor(r["taken"] / r["size"] + 0.5))
    got = Counter(r["doc_id"] for r in source_mix.stage(spark, docs, p).select("doc_id").collect())
    assert got == +want
    # cut-offs that are too many to be sent to all are joined, with the same rows
    assert Counter(r["doc_id"] for r in source_mix.stage(spark, docs, replace(p, most_cuts=0)).select("doc_id").collect()) == got


def test_repeated_rows_share_what_is_taken(spark):
    rows = [(i, "w " * 50, "a") for i in range(40)] + [(7, "w " * 50, "a")] * 60 + [(None, f"n{i} " * 50, "a") for i in range(50)] + [(100 + i, "w " * 30, "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mixed = source_mix.mix(spark, docs).collect()
    taken, target = defaultdict(int), {}
    for r in mixed:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    out = defaultdict(int)
    for r in source_mix.stage(spark, docs).collect():
        out[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - target[s]) <= 64 for s in target)
    # one group of repeats is rounded as a whole: 61 rows of 50 words, half of them at most
    assert all(abs(out[s] - target[s]) <= 61 * 25 + 64 for s in target)
    shards = {r["source"]: r["shards"] for r in source_mix.plan(spark, docs, source_mix.Params(shard_docs=10)).sources.collect()}
    hashes = {r["h"] for r in source_mix.plan(spark, docs.where("doc_id is null")).sizes.collect()}
    assert shards["a"] > 1 and len(hashes) == 50


def test_token_stage_equals_the_tokenizer(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    own, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in token_output.stage(spark, docs).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = [*own.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
