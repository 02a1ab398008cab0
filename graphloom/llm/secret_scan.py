"""Secret scan: candidate strings judged by a random forest that removes false positives, in DataFrame operations only.

A candidate is a private key in armour, or a maximal run (of name=value: the value) of 16 or more of [A-Za-z0-9+/_=-] other than a plain word (letters only, capitals at most in the first
place), or a value of any length and characters that is assigned or quoted after a word such as password, token or api_key, or that
stands between the colon and the @ of an URL's user. Features: its length, shares of character
kinds and of distinct characters, transitions between kinds, how much of it dictionary words cover, the path of its document,
and words before it. The forest is trained from labelled findings (before, candidate, after, path, label). The tables here hold
no labelled findings, so the query trains on `generated_findings`, a small table made by rule from a seeded generator; a user passes their own.

Null and empty texts have no candidate and give no row. Repeated rows give their candidates each. A null path counts as empty.
An empty table gives no rows; labelled findings of one kind only give that label to all. Extra columns are not read.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KIND = r"[A-Za-z0-9+/_=-]"
#: Of name=value the run is the value.
RUN = rf"(?:(?<!{KIND})|(?<=[A-Za-z0-9_]=))(?![A-Za-z_][A-Za-z0-9_]*+=[A-Za-z0-9+/_-])(?![A-Za-z][a-z]*+(?!{KIND})){KIND}{{16,}}+"
#: Cheap looks at what stands right before come first, as each look behind a long way is tried at each length.
#: After a word that names a secret: the value between quotes, else what stands up to a space or an end mark after : or =; an URL's password.
NAMED = r"(?i:secret|token|passw(?:or)?d|passphrase|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)[A-Za-z0-9_-]{0,24}+"
ASSIGNED = rf"(?<={NAMED}[\"']?[ \t]{{0,4}}(?:[:=]|:=|=>)[ \t]{{0,4}}(?:(?i:bearer|basic)[ \t]{{1,4}})?"
QUOTED = rf"(?<=\"){ASSIGNED}\")[^\"\n]{{1,512}}(?=\")|(?<='){ASSIGNED}')[^'\n]{{1,512}}(?=')"
BARE = rf"(?<=[:=> \t])(?<=[:=>][ \t]{{0,4}}|(?i:bearer|basic)[ \t]{{1,4}}){ASSIGNED})(?!(?i:bearer|basic)[ \t])[^\s\"'`,;(){{}}\[\]<>:=][^\s\"'`,;(){{}}\[\]<>]{{0,511}}"
USER = r"(?<=:)(?<=://[^\s/:@\"']{1,64}:)[^\s/@\"']{1,256}(?=@)"
#: A private key in armour, as one candidate from its first line to its last.
ARMOUR = r"-----BEGIN [A-Z0-9 ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END [A-Z0-9 ]{0,24}PRIVATE KEY-----"
CANDIDATE = f"{ARMOUR}|{QUOTED}|{USER}|{BARE}|{RUN}"

#: Words that names and prose are made of.
DICTIONARY = (
    "about", "access", "account", "action", "address", "admin", "after", "array", "before", "build", "button", "cache", "change",
    "check", "class", "client", "code", "column", "config", "content", "count", "create", "current", "data", "date", "default",
    "delete", "detail", "document", "element", "error", "event", "example", "field", "file", "filter", "first", "format", "function",
    "group", "handler", "header", "image", "index", "input", "item", "label", "last", "length", "list", "load", "local", "message",
    "method", "model", "module", "name", "number", "object", "option", "order", "output", "page", "param", "parse", "path", "point",
    "print", "process", "product", "profile", "query", "random", "record", "release", "request", "response", "result", "return",
    "schema", "script", "search", "section", "select", "server", "service", "session", "source", "start", "state", "status", "string",
    "system", "table", "target", "test", "text", "time", "title", "type", "update", "upload", "user", "value", "version", "view",
)

#: What stands before secrets, what stands before other long strings, and where strings are seldom secret.
BEFORE_SECRET = r"(?i)(secret|token|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)[^\n]{0,24}$"
BEFORE_OTHER = r"(?i)(sha\d*|md5|commit|checksum|digest|integrity|uuid|guid|rev(ision)?|etag|hash|order|invoice|card|isbn|version)[^\n]{0,16}$"
#: What stands for a value that is given elsewhere.
PLACE_HOLDER = r"(?i)^[<$%{].*[>}%]$|^(x+|\*+|\.+|none|null|true|false|required|string|changeme|change.?me|example|placeholder|your.*|my.*|todo)$|^[a-z_]+(\.[a-zA-Z_]+)+(\(.*)?$"
SAFE_PATH = r"(?i)(test|fixture|example|sample|mock|lock|vendor|node_modules|changelog)"


@dataclass(frozen=True)
class Params:
    trees: int = 40
    depth: int = 7
    seed: int = 17
    context: int = 48  # characters before a candidate that are looked at
    least_score: float = 0.5


def features(c: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Numbers that a candidate is judged by."""
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    left = F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")
    flag = lambda x: x.cast("double")
    return {
        "f_length": n,
        "f_digits": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_lower": share("[a-z]"),
        "f_marks": share("[+/_=-]"),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "f_letter_digit": share("[A-Za-z](?=[0-9])"),
        "f_digit_letter": share("[0-9](?=[A-Za-z])"),
        "f_case": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "f_runs": share("[a-z](?=[a-z])|[A-Z](?=[A-Z])"),
        "f_vowels": share("[aeiouAEIOU]"),
        "f_hex": flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "f_digits_only": flag(c.rlike("^[0-9_/+=-]+$")),
        "f_groups": flag(c.rlike("^[0-9A-Za-z]+(-[0-9A-Za-z]+){2,}$")),
        "f_words": 1 - F.length(left) / n,
        "f_safe_path": flag(path.rlike(SAFE_PATH)),
        "f_before_secret": flag(before.rlike(BEFORE_SECRET)),
        "f_before_other": flag(before.rlike(BEFORE_OTHER)),
        "f_assigned": flag(before.rlike("[:=]\\s*[\"']?$")),
        "f_armour": flag(c.startswith("-----BEGIN ")),
        "f_url": flag(before.rlike("://[^\\s/:@]*:$") & after.startswith("@")),
        "f_letters_only": flag(c.rlike("^[A-Za-z]+$")),
        "f_place_holder": flag(c.rlike(PLACE_HOLDER)),
        "f_quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
    }


def with_features(df: DataFrame) -> DataFrame:
    """df: candidate, before, after, path."""
    return df.withColumns(features(F.col("candidate"), F.col("before"), F.col("after"), F.coalesce("path", F.lit(""))))


NAMES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_marks", "f_distinct", "f_letter_digit", "f_digit_letter", "f_case", "f_runs", "f_vowels", "f_hex",
    "f_digits_only", "f_groups", "f_words", "f_safe_path", "f_before_secret", "f_before_other", "f_assigned", "f_armour", "f_url", "f_letters_only",
    "f_place_holder", "f_quoted",
]


def generated_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """n labelled findings by rule from a seeded generator: before, candidate, after, path, label.

    Keys and passwords of many forms behind words that name them, behind plain assignments, in URLs and in armour; against them digests,
    ids, numbers, names and identifiers, place holders behind the very same words, and keys of test files.
    """
    rng = random.Random(29)
    hexes, small, large = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    of = lambda kinds, k: "".join(rng.choice(kinds) for _ in range(k))
    mixed = lambda k: of(small + large + "0123456789", k)
    word = lambda: rng.choice(DICTIONARY)
    words = lambda k, mark: mark.join(word() for _ in range(k))
    keys = [
        lambda: of(hexes, 40), lambda: of(hexes, 32), lambda: of(hexes, 64), lambda: of(small + large + "0123456789+/", 40), lambda: "sk_live_" + mixed(24), lambda: "AKIA" + of(large + "234567", 16), lambda: "AKIA" + of(large, 16),
        lambda: "ghp_" + mixed(36), lambda: f"xoxb-{of('0123456789', 12)}-{mixed(24)}", lambda: mixed(rng.randrange(18, 48)), lambda: of(small + large, rng.randrange(18, 40)), lambda: f"{mixed(20)}.{mixed(36)}", lambda: f"{of(small, 3)}-{mixed(20)}_{mixed(8)}",
    ]
    marks = "!#$%&*?@^"
    passwords = [
        lambda: mixed(rng.randrange(4, 9)) + rng.choice(marks) + mixed(rng.randrange(2, 5)), lambda: word() + of("0123456789", 3) + rng.choice(["", "!", "?", "#"]), lambda: word().title() + rng.choice("$&-_!") + word().title() + str(rng.randrange(100)),
        lambda: mixed(rng.randrange(8, 15)), lambda: of(small, 9), lambda: words(4, " "), lambda: " ".join(of(small, rng.randrange(3, 9)) for _ in range(rng.randrange(3, 6))), lambda: words(3, "-") + str(rng.randrange(100)),
    ]
    others = [
        lambda: of(hexes, 40), lambda: of(hexes, 64), lambda: "-".join(of(hexes, k) for k in (8, 4, 4, 4, 12)), lambda: of("0123456789", 16), lambda: f"2024-{of('0123456789', 2)}-{of('0123456789', 10)}",
        lambda: word() + "".join(word().title() for _ in range(3)) + str(rng.randrange(97)), lambda: word() + "".join(word().title() for _ in range(3)), lambda: words(4, "_"), lambda: words(4, "/"), lambda: words(3, "-") + "-" + str(rng.randrange(9)), lambda: "".join(word().title() for _ in range(4)),
    ]
    named = ['token = "', "password: '", "api_key=", 'secret = "', "Authorization: Bearer ", "aws_secret_access_key = ", '"auth_token": "', 'the TOKEN = "', "private-key: ", "passwd=", "client_secret: ", "credential: '", "pwd="]
    assigned = ['key = "', "value: '", 'x = "', 'Client("', "hook: ", "signature=", "id="]
    other_lead = ["commit ", "revision ", "sha1: ", "sha256:", "digest ", "integrity: ", "uuid ", "guid: ", "request id ", "order no ", "card ", "call ", "import ", "see ", "in ", '"', "on ", "the ", "= "]
    holders = ["changeme", "your_api_key_here", "xxxxxxxxxxxxxxxx", "example", "required", "string", "None", "true", "null", "${SECRET}", "<token>", "process.env.TOKEN", "os.environ", "config.password", "********", "{{ password }}", "YOUR_TOKEN", "placeholder", "todo"]
    lead = lambda: rng.choice(["", "set ", "\n", "and the ", "  ", "config\n", "export "])
    folder, mild, fixed = ["src/app/config.py", "deploy/.env", "settings.yaml", "src/app/main.py", "", "web", "docs/setup.md"], ["package-lock.json", "src/app/main.py", "tests/fixtures/a.txt", "docs/changelog.md", "", "web", "deploy/.env"], ["tests/fixtures/a.txt", "examples/mock.py"]
    end = ['" and', "' then", "\n", '"', " "]
    scheme = ["postgres", "mongodb", "redis", "https", "amqp"]
    armour = lambda: f"-----BEGIN {rng.choice(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----\n" + "\n".join(of(small + large + "0123456789+/", 64) for _ in range(rng.randrange(1, 5))) + "\n-----END PRIVATE KEY-----"
    # share, what stands before, candidates, what stands behind, paths, label
    kinds = [
        (22, lambda: lead() + rng.choice(named), keys, end, folder, 1.0), (14, lambda: lead() + rng.choice(named), passwords, end, folder, 1.0), (8, lambda: lead() + rng.choice(assigned), keys[3:], end, folder, 1.0),
        (6, lambda: f"{lead()}{rng.choice(scheme)}://{word()}:", [*passwords[:5], *keys[9:11]], ["@db.host", "@10.0.0.1/x"], folder, 1.0), (3, lead, [armour], ["\n"], folder, 1.0),
        (26, lambda: lead() + rng.choice(other_lead), others, [" and", ", on", "\n", ")", '"'], mild, 0.0), (8, lambda: lead() + rng.choice(assigned), others[5:], end, mild, 0.0),
        (9, lambda: lead() + rng.choice(named), [lambda: rng.choice(holders)], end, folder, 0.0), (2, lambda: f"{lead()}https://user:", [lambda: rng.choice(["password", "<password>", "${PASS}", "xxxx"])], ["@host"], folder, 0.0), (4, lambda: lead() + rng.choice(named), keys, end, fixed, 0.0),
    ]
    rows = []
    for share, before, made, after, paths, label in kinds:
        rows += [(before(), rng.choice(made)(), rng.choice(after), rng.choice(paths), label) for _ in range(share * n // sum(k[0] for k in kinds))]
    return spark.createDataFrame(rows, "before string, candidate string, after string, path string, label double")


def candidates(docs: DataFrame, p: Params = Params(), path: str = "source") -> DataFrame:
    """doc_id, path, start (code points), candidate, before, after: all candidates of whole texts."""
    there = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    read = docs.select("doc_id", there.alias("path"), "text").where(F.col("text").rlike(CANDIDATE))
    cut = read.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split("text", CANDIDATE, -1).alias("p"))
    one = cut.select(
        "row", "doc_id", "path",
        F.posexplode(F.zip_with(F.arrays_zip("c", F.slice(F.concat(F.array(F.lit("")), "c"), 1, F.size("c")).alias("last")), F.slice("p", 1, F.size("c")), lambda z, x: F.struct(z["c"].alias("candidate"), F.length(x).alias("gap"), F.right(F.concat(z["last"], x), F.lit(p.context)).alias("before")))).alias("k", "r"),
        F.transform(F.slice("p", 2, F.size("p")), lambda x: F.left(x, F.lit(8))).alias("tails"),
    ).select("row", "doc_id", "path", "k", "r.*", F.get("tails", F.col("k")).alias("after"))
    so_far = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("gap") + F.length("candidate")).over(so_far) - F.length("candidate")
    return one.select("doc_id", "path", start.cast("long").alias("start"), "candidate", "before", "after")


def train(findings: DataFrame, p: Params = Params()):
    """A forest over labelled findings (before, candidate, after, path, label)."""
    table = VectorAssembler(inputCols=NAMES, outputCol="features").transform(with_features(findings))
    return RandomForestClassifier(numTrees=p.trees, maxDepth=p.depth, seed=p.seed, featureSubsetStrategy="sqrt").fit(table.select("features", "label"))


def scan(spark: SparkSession, docs: DataFrame, findings: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, start, length, candidate_sha256, before_secret, score, is_secret of each candidate."""
    model = train(findings, p)
    table = VectorAssembler(inputCols=NAMES, outputCol="features").transform(with_features(candidates(docs, p)))
    scored = model.transform(table).withColumn("score", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))
    return scored.select("doc_id", "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), (F.col("f_before_secret") > 0).alias("before_secret"), "score", (F.col("score") >= p.least_score).alias("is_secret"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(spark, docs, generated_findings(spark))
