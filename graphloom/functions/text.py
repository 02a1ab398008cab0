"""Tokens, literal containment, name boosts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Letters with marks and the letters without them, by canonical decomposition; then the marks themselves, which fold to nothing."""
    letters = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000))) if c == c.lower()}
    letters = {c: plain for c, plain in letters.items() if plain != c and plain.isalpha()}
    return "".join(letters) + "".join(map(chr, range(0x300, 0x370))), "".join(letters.values())


#: Lower-case letters with marks and what they fold to; what has no counterpart (the marks) goes.
ACCENTED, PLAIN = _folding()
FOLD = str.maketrans(dict(zip(ACCENTED, [*PLAIN, *[None] * (len(ACCENTED) - len(PLAIN))], strict=True)))
NOT_TOKEN = r"[^\p{L}\p{N}]+"


def folded(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case without accents; an underscore parts tokens."""
    return F.filter(F.split(folded(F.coalesce(c, F.lit(""))), NOT_TOKEN), lambda x: x != "")


def phrase_count(hits: Column, phrase: list[str], prefix: bool = False, column: int | None = None) -> Column:
    """How often the words of a phrase stand side by side among hits (c: column, w: token, i: place); with prefix the last word may go on."""

    def fits(x: Column, k: int) -> Column:
        return x["w"].startswith(phrase[k]) if prefix and k == len(phrase) - 1 else x["w"] == phrase[k]

    def here(x: Column) -> Column:
        def behind(k: int) -> Column:
            return F.exists(hits, lambda y: (y["c"] == x["c"]) & (y["i"] == x["i"] + k) & fits(y, k))

        out = fits(x, 0) if column is None else fits(x, 0) & (x["c"] == column)
        for k in range(1, len(phrase)):
            out = out & behind(k)
        return out

    return F.size(F.filter(hits, here))


def like_contains(c: Column, query: str) -> Column:
    """LIKE %query% without regard to case; % and _ of the query are wildcards."""
    return F.lower(c).like("%" + query.lower().replace("\\", "\\\\") + "%")


def exact_boost(query: str, name: Column, title: Column) -> Column:
    """What a name or title close to the query adds: 0.30 equal, 0.15 at its start, 0.05 within."""
    q = query.strip().lower()
    n, t = F.lower(name), F.lower(title)
    return F.when((n == q) | (t == q), 0.30).when(n.startswith(q) | t.startswith(q), 0.15).when(n.contains(q) | t.contains(q), 0.05).otherwise(0.0)


def cosine(vector: Column, query: list[float]) -> Column:
    """v q / (|v| (|q| + 1e-9) + 1e-9) in doubles."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (own * (norm + 1e-9) + 1e-9)
