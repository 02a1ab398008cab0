"""Every operator over rows of every odd kind: nulls in any column, empty and long texts, repeated rows, clashing names, no rows."""

from __future__ import annotations

import pytest

from graphloom.llm import decontamination, language_id, license_scan, merkle, near_duplicates, secret_scan, source_mix, suffix_dedup, token_output, toxicity

LONG = "the quick onre brown fox " * 3000
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, bucket int, component_id long, labels string, row long, kind int"
EXTRA = (0.5, 7, 3, 9, "mine", 1, 2)
ROWS = [
    (1, "hello there of the world again", "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (4, LONG, "en", "a", len(LONG)), (None, "no id of any kind here", "de", "b", 3),
    (None, None, None, None, None), (5, "hello there of the world again", "en", "b", 5), (5, "hello there of the world again", "en", "b", 5), (6, "Released under the MIT License.", None, "b", 1),
    (7, "  \n\t ", "en", None, 6), (8, "12 34 !!", "de", "a", 8), (9, "éàü ñ \U0001f600 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "fr", "a", 9), (-3, "GNU General Public License", "en", "a", 2), (10, LONG + "x", "de", "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + EXTRA for r in ROWS], COLUMNS).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (4, None, None), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "hello there of the world again"), (2, None), (3, ""), (3, "gnu general public")], "item_id long, text string")


PER_ROW = {
    "op1": lambda s, d, l, b: license_scan.query(s, d),
    "op3": lambda s, d, l, b: language_id.query(s, d),
    "op4": lambda s, d, l, b: token_output.query(s, d),
    "op5": lambda s, d, l, b: source_mix.query(s, d),
    "op6": lambda s, d, l, b: merkle.query(s, d),
    "op8": lambda s, d, l, b: toxicity.query(s, d, l),
    "op9": lambda s, d, l, b: suffix_dedup.query(s, d),
    "op10": lambda s, d, l, b: near_duplicates.query(s, d),
}
OTHER = {"op2": lambda s, d, l, b: secret_scan.query(s, d), "op7": lambda s, d, l, b: decontamination.query(s, d, b)}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_each(spark, docs, labels, benchmark, name):
    got = [r["doc_id"] for r in PER_ROW[name](spark, docs, labels, benchmark).collect()]
    assert sorted(got, key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", [*PER_ROW, *OTHER])
def test_empty_tables(spark, none, labels, benchmark, name):
    f = (PER_ROW | OTHER)[name]
    assert f(spark, none, labels.limit(0), benchmark.limit(0)).count() == 0
    assert f(spark, none, labels, benchmark).count() == 0


def test_secrets_and_leaks(spark, docs, benchmark):
    found = secret_scan.query(spark, docs).collect()
    assert [(r["doc_id"], r["start"], r["length"]) for r in found] == [(9, 17, 40)]
    leaks = {(r["doc_id"], r["item_id"]) for r in decontamination.query(spark, docs, benchmark).collect()}
    assert leaks == {(1, 1), (5, 1), (-3, 3)}
    assert decontamination.query(spark, docs, benchmark.limit(0)).count() == 0


def test_stages_keep_columns(spark, docs, none, benchmark):
    for f in (language_id.stage, near_duplicates.stage, source_mix.stage, lambda s, d: decontamination.stage(s, d, benchmark)):
        assert f(spark, docs).columns == docs.columns
        assert f(spark, none).count() == 0


def test_near_duplicate_stage(spark, docs):
    kept = sorted((r["doc_id"] for r in near_duplicates.stage(spark, docs).collect()), key=str)
    # 5 (twice) copies 1; 10 is near 4; rows without words stay, one of each id
    assert kept == sorted([1, 2, 3, 4, None, None, 6, 7, 8, 9, -3], key=str)


def test_language_stage_drops_letterless(spark, docs):
    kept = {r["doc_id"] for r in language_id.stage(spark, docs).collect()}
    assert not kept & {2, 3, 7, 8} and {1, 4, 6} <= kept
