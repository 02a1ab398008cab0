"""License scan: exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block is a line of a text, or as many words in a row as the template's words over `containment`, however they are wrapped;
it meets a template when it holds at least `containment` of the template's distinct words, and of these all that tell licenses apart
(`TELLING`): without `lesser` no block is of the LGPL, though all other words of its notice stand there.
Words are ordered by how many documents of the whole corpus hold them, rarest first. A block that meets a template of n
words holds one of its first n - ceil(containment * n) + 1 words (prefix filter), holds ceil(containment * n) template
words at all (length filter), and has enough words left behind the first common one on both sides (positional filter).
What passes is counted exactly. Rows of words are looked at around each word of a prefix, in texts that hold enough of some
template. Templates are a constant list, so the joined side is small whatever the corpus is; blocks
are never moved: only one row a document is shuffled.

Beside the join stand fixed phrases whose places are counted in the words of the whole text.

Null and empty texts have no words: 0 places, null first and last word, empty labels, score 0. Repeated rows stay apart, each
with its result (rows are told apart by their place in the input). An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower

#: Characters between words: ASCII other than digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public license notices, as words, in the order of their labels.
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("artistic", "you may distribute this package under the terms of the artistic license 2 0"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("eupl", "licensed under the european union public licence version 1 2"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)

#: Words that tell licenses of like wording apart. A block that meets a template holds all of these that the template
#: holds, whatever else of it is lacking.
TELLING = (
    "affero", "apache", "artistic", "boost", "cc", "cc0", "creative", "documentation", "eclipse", "european", "general", "lesser", "mit", "mozilla", "nc", "nd", "noncommercial",
    "organization", "sa", "sharealike", "unencumbered",
)


@dataclass(frozen=True)
class Params:
    containment: Fraction = Fraction(4, 5)
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    telling: tuple[str, ...] = TELLING


def words(text: Column) -> Column:
    """The words of a text already in lower case, with an empty one before or behind if it starts or ends with a gap."""
    return F.split(text, GAPS)


def _literal(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary occurs; a count over the whole corpus, as large as the vocabulary."""
    held = docs.select(F.explode(F.array_intersect(_literal(vocabulary), words(ascii_lower(F.col("text"))))).alias("w"))
    return {r["w"]: r["count"] for r in held.groupBy("w").count().collect()}


def scan(spark: SparkSession, docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks (blocks that meet a template)."""
    vocabulary = sorted({w for _, t in p.templates for w in t.split()})
    df = document_frequency(docs, vocabulary)
    ordered = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    place = {w: i for i, w in enumerate(ordered)}
    prefixes, least, reach = [], None, 0
    for k, (label, text) in enumerate(p.templates):
        own = sorted(set(text.split()), key=place.__getitem__)
        need = ceil(p.containment * len(own))
        least = need if least is None else min(least, need)
        span = ceil(len(text.split()) / p.containment)
        reach = max(reach, span - 1)
        must = [w for w in own if w in p.telling]
        prefixes += [(w, k, label, own, len(own), i, need, span, must) for i, w in enumerate(own[: len(own) - need + 1])]
    index = spark.createDataFrame(prefixes, "token string, template int, label string, own array<string>, n int, i int, need int, span int, must array<string>")
    rare = _literal(sorted({x[0] for x in prefixes}))

    # before the explosion: a number given beside it would differ between the blocks of one row
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(ascii_lower(F.col("text")), F.lit("")).alias("t")).withColumn("w", words(F.col("t")))
    w, size = F.col("w"), F.size("w")
    lead = (F.get(w, F.lit(0)) == "").cast("int")
    trail = ((size > 1) & (F.get(w, size - 1) == "")).cast("int")
    starts = None
    for phrase in PHRASES:
        parts = phrase.split()
        here = lambda i, parts=parts: F.get(w, i) == parts[0]
        every = lambda i, parts=parts, here=here: [here(i)] + [F.get(w, i + k) == x for k, x in enumerate(parts) if k]
        hit = lambda i, every=every: _all(every(i))
        starts = [*(starts or []), hit]
    at_all = None
    for phrase in PHRASES:
        has = F.array_contains(w, phrase.split()[-1]) & F.array_contains(w, phrase.split()[0])
        at_all = has if at_all is None else at_all | has
    places = F.when(at_all, F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(_any([s(i) for s in starts]), F.lit(False)))).otherwise(F.array().cast("array<int>"))
    label_of = F.create_map(*[F.lit(x) for k, v in PHRASES.items() for x in (k.split()[0], v)])
    some = F.arrays_overlap(w, rare)
    blocks = F.when(
        some,
        F.filter(F.transform(F.split("t", "\n"), lambda x: F.array_intersect(_literal(ordered), words(x))), lambda o: (F.size(o) >= least) & F.arrays_overlap(o, rare)),
    )
    lines = F.transform(F.coalesce(blocks, F.array().cast("array<array<string>>")), lambda o: F.struct(o.alias("o"), F.lit(None).cast("array<string>").alias("near"), F.lit(None).cast("string").alias("token"), F.lit(0).alias("before")))
    # words around each word of a prefix; only where words of a template go on over a line's end
    wrapped = some & F.col("t").contains("\n") & _any([F.size(F.array_intersect(w, _literal(own))) >= need for own, need in sorted({(tuple(x[3]), x[6]) for x in prefixes})])
    at = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.array_contains(rare, F.get(w, i)))
    around = F.when(wrapped, F.transform(at, lambda i: F.struct(F.lit(None).cast("array<string>").alias("o"), F.slice(w, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach + 1).alias("near"), F.get(w, i).alias("token"), F.least(i, F.lit(reach)).alias("before"))))
    around = F.coalesce(around, F.slice(lines, 1, 0))
    one = read.select(
        "row",
        "doc_id",
        (size - lead - trail).cast("long").alias("n_words"),
        lead.alias("lead"),
        places.alias("places"),
        F.transform(places, lambda i: label_of[F.get(w, i)]).alias("base"),
        F.explode_outer(F.concat(lines, around)).alias("b"),
    ).select("*", "b.o", "b.near", "b.token", "b.before").drop("b")
    base = F.array_sort(F.array_distinct("base"))
    one = one.select(
        "row", "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        (F.array_min("places") - F.col("lead")).cast("long").alias("first_word"),
        (F.array_max("places") - F.col("lead")).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        "o", "near", "before",
        F.posexplode_outer(F.when(F.col("near").isNull(), F.col("o")).otherwise(F.array("token"))).alias("j", "token"),
    )
    met = one.join(F.broadcast(index), "token", "left")
    held = lambda x: F.when(F.size(F.array_except("must", x)) == 0, F.size(F.array_intersect("own", x)))
    left = F.least(F.col("n") - F.col("i"), F.size("o") - F.col("j"))
    overlap = F.when((F.size("o") >= F.col("need")) & (left >= F.col("need")), held(F.col("o")))
    span, before = F.col("span"), F.col("before")
    near = F.slice("near", F.greatest(before - span + 1, F.lit(0)) + 1, F.least(before, span - 1) + span)
    # all rows of `span` words that hold the prefix word, which is the near part's word of place least(before, span - 1)
    inside = F.when(held(near) >= F.col("need"), F.array_max(F.transform(F.sequence(F.lit(0), F.least(before, span - 1)), lambda s: held(F.slice(near, s + 1, span)))))
    overlap = F.when(F.col("near").isNull(), overlap).otherwise(inside)
    met = met.withColumn("found", F.when(overlap >= F.col("need"), overlap / F.col("n")))
    keys = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    done = met.groupBy(*keys).agg(
        F.collect_set(F.when(F.col("found").isNotNull(), F.col("label"))).alias("more"),
        F.coalesce(F.max("found"), F.lit(0.0)).alias("best"),
    )
    of_base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    return done.select(
        *keys[1:],
        F.array_join(F.array_sort(F.array_union(of_base, "more")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.col("best")).alias("score"),
    )


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out & x
    return out


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out | x
    return out


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(spark, docs)


def oracle(p: Params = Params()) -> str:
    """The same rows by brute force: every line against every template."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    must = lambda t: "CAST(" + quoted(sorted(set(t.split()) & set(p.telling))) + " AS VARCHAR[])"
    templates = ", ".join(f"({k}, '{label}', {quoted(sorted(set(t.split())))}, {ceil(p.containment * len(set(t.split())))}, {must(t)})" for k, (label, t) in enumerate(p.templates))
    hits = " OR ".join("(" + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(ph.split())) + ")" for ph in PHRASES)
    names = " ".join(f"WHEN w[i] = '{ph.split()[0]}' THEN '{label}'" for ph, label in PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(translate(text, '{upper}', '{lower}'), '') AS t FROM documents),
s AS (SELECT doc_id, r, t, regexp_extract_all(t, '{word}') AS w FROM d),
spot AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM s),
b AS (SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT CASE {names} END) AS base FROM spot WHERE {hits} GROUP BY r),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM s),
lw AS (SELECT r, list_distinct(regexp_extract_all(x, '{word}')) AS x FROM line),
tp(k, label, own, need, must) AS (VALUES {templates}),
m AS (SELECT r, label, len(list_intersect(own, x)) / len(own) AS c FROM lw, tp WHERE len(list_intersect(own, x)) >= need AND list_has_all(x, must)),
g AS (SELECT r, list(DISTINCT label) AS more, max(c) AS best FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
 CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM s LEFT JOIN b USING (r) LEFT JOIN g USING (r)"""
