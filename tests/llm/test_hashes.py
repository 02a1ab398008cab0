"""Texts made to meet under weak hashes: mirrored Thue-Morse words, against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import bytewords, decontamination, merkle, near_duplicates, suffix_dedup


def morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def mirrored(n: int) -> str:
    return morse(n).translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module", params=[1024, 4096])
def pair(request):
    return morse(request.param), mirrored(request.param)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_spans_differ(pair):
    for texts in (pair, (pair[0][:32], pair[1][:32]), (pair[0][:8], pair[1][:8]), ("a" * 33, "a" * 34), ("abcdefgh", "abcdefgh\0")):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        h = bytewords.span_hashes(data, np.array([0, len(texts[0])]), np.array([len(texts[0]), len(data)]))
        assert h[0] != h[1]


def test_fingerprints_differ(spark, pair):
    got = {r["doc_id"]: r for r in merkle.query(spark, docs(spark, [*pair, pair[0]])).collect()}
    assert got[0]["fingerprint"] != got[1]["fingerprint"] and got[0]["fingerprint"] == got[2]["fingerprint"] and got[0]["near_next"] == 0.0 and got[2]["near_next"] == 1.0


def test_no_link_between_them(spark, pair):
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.query(spark, docs(spark, [*pair, pair[1], f"{pair[0]} w x y z", f"{pair[1]} w x y z"])).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4}


def test_no_leak_between_them(spark, pair):
    items = spark.createDataFrame([(7, f"{pair[0]} second third")], "item_id long, text string")
    found = decontamination.query(spark, docs(spark, [f"x {pair[0]} second third y", f"x {pair[1]} second third y"]), items)
    assert [r["doc_id"] for r in found.collect()] == [0]


def test_repeats(spark, pair):
    texts = [*pair, pair[0][: len(pair[0]) // 2], f"{pair[1]}c{pair[0][:200]}"]
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.query(spark, docs(spark, texts)).collect()}
    seen: set[str] = set()
    for k, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(t[i : i + 100])
        left = "".join(c for c, g in zip(t, gone, strict=True) if not g)
        assert got[k] == (int(gone.sum()), hashlib.sha256(left.encode()).hexdigest())


def plain_root(text: str) -> str:
    """The root by its definition, word by word."""
    data = text.encode()
    blake = lambda x, level: hashlib.blake2b(x, digest_size=16, person=level).digest()
    words, i = [], 0
    space = b" \t\n\x0b\x0c\r"
    while i < len(data):
        if data[i] in space:
            i += 1
            continue
        j = i
        while j < len(data) and data[j] not in space:
            j += 1
        words.append((i, j))
        i = j
    cuts = lambda a, b: not int(bytewords.span_hashes(np.frombuffer(data, np.uint8), np.array([a]), np.array([b]))[0]) & 3
    starts, lines = [], []
    for k, (a, _) in enumerate(words):
        new_line = k == 0 or b"\n" in data[words[k - 1][1] : a]
        if new_line or cuts(*words[k - 1]):
            starts.append(a)
            lines.append(new_line)
    if data and not words:
        starts, lines = [0], [True]
    if starts:
        starts[0] = 0
    leaves = [blake(data[a:b], b"leaf") for a, b in zip(starts, [*starts[1:], len(data)])]  # noqa: B905  no start, no leaf
    paragraphs: list[bytes] = []
    for x, new in zip(leaves, lines, strict=True):
        paragraphs = [*paragraphs, x] if new else [*paragraphs[:-1], paragraphs[-1] + x]
    sections, closed = [], True
    for p in (blake(x, b"paragraph") for x in paragraphs):
        sections = [*sections, p] if closed else [*sections[:-1], sections[-1] + p]
        closed = not int.from_bytes(p[4:8], "little") & 3
    top = b"".join(blake(x, b"section") for x in sections)
    return hashlib.sha256(top + len(data).to_bytes(8, "little")).hexdigest()[:32]


def test_roots_by_brute_force():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdé"), int(rng.integers(1, 40 if rng.random() < 0.1 else 6))))
    texts = ["", " ", "\n\n", "a", "é\n", *("".join(word() + rng.choice([" ", "  ", "\n", "\n\n", "\t"]) for _ in range(int(rng.integers(1, 120)))) for _ in range(60))]
    assert [f[:32] for f, _ in merkle.trees(pa.array(texts, pa.large_string()))] == list(map(plain_root, texts))
