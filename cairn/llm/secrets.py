"""Secret scans in DataFrame operations only.

Patterns find candidates: values assigned to a word such as password or token, whatever their signs, passwords in
addresses, and longer runs of an encoded value. A random forest, written out as one SQL expression, removes false
positives. Its features are the candidate's length, digits, character transitions, distinct characters, the share that
words of the dictionary cover, the neighbouring words on both sides and the document's path. The dictionary holds the
words that the corpus itself uses often, counted over all documents. The forest is trained on the driver from labelled
findings (``labelled``, or those that ``findings`` makes), whose features Spark computes by the same expressions.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import small
from . import kernel as K

#: Words before a value that speak for a secret.
SAID = r"passw(?:or)?d|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|authorization"
#: A value of six signs or more that is assigned to such a word. The first two tests are cheap and leave few places for the third.
_ASSIGNED_TO = rf"(?<=[=:\s\"'`])(?<=[=:]\s{{0,3}}[\"'`]{{0,1}})(?<=(?i:{SAID})[\"'`]{{0,1}}\s{{0,3}}[=:]\s{{0,3}}[\"'`]{{0,1}})(?!(?i:bearer|basic|null|none|true|false)\b)[^\s\"'`,;]{{6,}}"
#: The password of an address such as scheme://user:password@host.
_IN_ADDRESS = r"(?<=:)(?<=://[^\s:/@]{1,64}:)[^\s:/@]{6,}(?=@)"
#: 16 characters or more of an encoded value with a digit among them, not part of a longer word.
_RUN = r"(?<![\p{L}\p{N}+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}"
CANDIDATE = f"(?:{_ASSIGNED_TO}|{_IN_ADDRESS}|{_RUN})"
#: Characters on each side of a candidate that count as its neighbourhood.
NEAR = 40
WORDS = rf"(?i)({SAID}|auth|bearer|private|credential)"
ASSIGNED = r"[=:]\s*[\"'`]?$"
#: Neighbouring words that speak against a secret.
AGAINST = r"(?i)\b(commit|sha-?(?:1|256|512)|md5|checksum|digest|revision|uuid|guid|isbn|doi|order|page|version|build|example|placeholder|sample|dummy|https?)\b"
#: A word is in the dictionary if this share of all documents, and two at least, hold it; so it has at most 1 / SHARE times as many
#: words as a document has distinct ones on average.
SHARE = 0.001
#: Labelled findings that the forest is trained on at most (those of the smallest hash), and how many the module makes itself.
LABELLED, EXAMPLES = 20_000, 1200
TREES, DEPTH = 25, 7
FEATURES = ("length", "digits", "transitions", "distinct", "coverage", "separators", "signs", "hex", "word", "assigned", "against", "quoted", "path")


def features() -> dict[str, Column]:
    """Of rows (value, near, after, path, covered); near and after are the text beside the value, covered its characters in words."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    removed = lambda pattern: (n - F.length(F.regexp_replace(v, pattern, ""))) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    edges = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    return dict(zip(FEATURES, (
        n, removed("[0-9]"), (F.size(F.split(v, edges)) - 1) / n, F.size(F.array_distinct(F.split(v, ""))) / n, F.col("covered") / n, removed("[+/_=-]"), removed("[A-Za-z0-9+/_=-]"),
        flag(v.rlike("^[0-9a-fA-F]+$")), flag(F.col("near").rlike(WORDS) | F.col("after").rlike(WORDS)), flag(F.col("near").rlike(ASSIGNED)),
        flag(F.col("near").rlike(AGAINST) | F.col("after").rlike(AGAINST)), flag(F.col("near").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")), flag(F.col("path").rlike("(?i)(test|example|sample|fixture|docs?/)")),
    ), strict=True))


def dictionary(docs: DataFrame, text: str = "text", share: float = SHARE) -> DataFrame:
    """(word, docs) of the words of 3 to 20 letters, lower case, that ``share`` of all documents hold, and two at least."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w).between(3, 20)))
    least = max(2, int(np.ceil(share * docs.count())))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)


def covered(rows: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """Adds covered: the characters of value in runs of letters (cut where an upper-case letter follows a lower-case one) that are words. ``by`` identifies a row."""
    runs = F.filter(F.regexp_extract_all("value", F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    found = rows.select(*by, F.explode(F.transform(runs, F.lower)).alias("word")).join(small(words.select("word")), "word", "left_semi")
    sums = found.groupBy(*by).agg(F.sum(F.length("word")).alias("covered"))
    return rows.join(sums, by, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def findings(words: list[str], n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(value, text before it, text after it, path, label) of labelled findings: half secrets, half what only looks like them, made with ``words`` of the dictionary."""
    r = random.Random(seed)
    of = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    lower, digits = alnum[:26], "0123456789"
    word = lambda: r.choice(words)
    name = lambda: r.choice(["token", "secret", "api_key", "apiKey", "password", "passwd", "access_key", "client_secret", "AUTH_TOKEN", "API_KEY", "private-key"])
    plain = lambda: r.choice([f"{word()} {word()} ", f"{word()}. ", "", "see ", "id ", "number ", "= ", "order: ", "page=", "commit ", "version ", "sha256:", "uuid ", f"{word()} = \"", f"{word()}: "])
    said = lambda: r.choice([f'{name()} = "', f"{name()}: ", f"{name()}='", f"{name()}=", "Authorization: Bearer ", f"export {name()}=", f'"{name()}": "', "postgres://user:"])
    secrets = [lambda: of(hexa, r.choice([32, 40, 64])), lambda: of(hexa.upper(), r.choice([32, 40])), lambda: of(alnum, r.randint(20, 48)), lambda: "AKIA" + of(alnum[26:].upper(), 16), lambda: of(alnum + "+/", r.choice([40, 64, 86])) + "==", lambda: "ghp_" + of(alnum, 36), lambda: f"sk_live_{of(alnum, 24)}", lambda: f"xoxb-{of(digits, 12)}-{of(alnum, 24)}"]
    passwords = [lambda: word() + of(digits, r.randint(2, 4)) + r.choice(["!", "", "#", "$"]), lambda: of(alnum + "!#$%&*?@^", r.randint(8, 16)), lambda: word().capitalize() + r.choice("!@#$%") + word() + of(digits, 2), lambda: of(lower, r.randint(8, 14))]
    others = [
        lambda: of(digits, r.randint(16, 24)), lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 9999)}", lambda: f"{word()}_{word()}_{word()}_{r.randint(1, 2030)}", lambda: "".join(word().capitalize() for _ in range(4)) + str(r.randint(1, 99)),
        lambda: f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{word()}-{word()}", lambda: f"{word()}/{word()}/{word()}/{word()}{r.randint(1, 99)}", lambda: "-".join(of(digits, 4) for _ in range(r.randint(4, 6))),
        lambda: f"{of(hexa, 8)}-{of(hexa, 4)}-4{of(hexa, 3)}-a{of(hexa, 3)}-{of(hexa, 12)}", lambda: word() + word() + word() + str(r.randint(0, 9)) + word(), lambda: "-" * r.randint(8, 20) + str(r.randint(1, 99)) + "-" * 8, lambda: of(hexa, r.choice([32, 40, 64])),
    ]
    unset = [lambda: f"<{word()}>", lambda: f"${{{name().upper()}}}", lambda: f"your_{name()}_here", lambda: "x" * r.randint(6, 20), lambda: "*" * r.randint(6, 12), lambda: f"{word()}_{word()}", lambda: f"os.environ[{word()}]", lambda: f"get_{word()}({word()})", lambda: f"{word()}{word()}"]
    rows = []
    for k in range(n):
        good, near = k % 2, plain()
        if good and r.random() < 0.3:
            value, near = r.choice(passwords)(), said()
        elif good:
            value, near = r.choice(secrets)(), said() if r.random() < 0.8 else near
        elif r.random() < 0.3:
            value, near = r.choice(unset)(), said()
        else:
            value = r.choice(others)()
            if set(value) <= set(hexa):  # a bare digest is told from a secret by what stands beside it
                near = r.choice(["commit ", "sha256:", "md5 ", "checksum ", "digest: ", "revision "])
        after = near[-1] if near[-1:] in "\"'" and near else r.choice(["", " ", ".", f" {word()}", f". {word()} {word()}", "@db.example.net" if near.startswith("postgres") else ","])
        rows.append((value, near, after, r.choice(["src1", "web/a", "tests/x", "docs/b"]) if r.random() < 0.5 else "", good))
    return rows


def _grow(x: np.ndarray, y: np.ndarray, r: np.random.Generator, depth: int) -> tuple | float:
    """A tree as (feature, bound, at most, above) or a leaf's share of secrets; each split is the best by Gini of a third of the features."""
    if depth == 0 or len(y) < 4 or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    best = (np.inf, 0, 0.0)
    for f in r.choice(x.shape[1], 5, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if len(at):
            n, k, a, b = at + 1.0, len(y) - at - 1.0, ones[at], ones[-1] - ones[at]
            cost = 2 * a * (n - a) / n + 2 * b * (k - b) / k
            i = int(cost.argmin())
            best = min(best, (float(cost[i]), int(f), round(float(v[at[i]] + v[at[i] + 1]) / 2, 6)))
    left = x[:, best[1]] <= best[2]
    if best[0] == np.inf or left.all() or not left.any():
        return float((y.sum() + 0.5) / (len(y) + 1))
    return best[1], best[2], _grow(x[left], y[left], r, depth - 1), _grow(x[~left], y[~left], r, depth - 1)


def forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list:
    r = np.random.default_rng(seed)
    return [_grow(x[i], y[i], r, depth) for i in (r.integers(0, len(y), len(y)) for _ in range(trees))] if len(y) else [0.5]


def expression(trees: list) -> str:
    """The mean of the trees' leaves as SQL over columns f_<feature>."""
    def one(t) -> str:
        return f"{t:.6f}D" if isinstance(t, float) else f"CASE WHEN f_{FEATURES[t[0]]} <= {t[1]}D THEN {one(t[2])} ELSE {one(t[3])} END"

    return f"({' + '.join(one(t) for t in trees)}) / {len(trees)}"


def own_findings(spark: SparkSession, words: DataFrame, n: int = EXAMPLES, seed: int = 7) -> DataFrame:
    """``findings`` as a table, made with the 300 most frequent words of the dictionary (letters a to z, four at least)."""
    top = [x.word for x in words.where("word RLIKE '^[a-z]{4,}$'").orderBy(F.desc("docs"), "word").limit(300).collect()]
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({quoted(v)}, {quoted(a)}, {quoted(b)}, {quoted(p)}, {y})" for v, a, b, p, y in findings(top or ["value"], n, seed))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(value, near, after, path, label)")


def trained(labelled: DataFrame, words: DataFrame) -> list:
    """The forest from labelled findings (value, near, after, path, label: 1 for a secret)."""
    few = labelled.select("value", "near", "after", "path", F.col("label").cast("int").alias("label")).where("value IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("value", "near"), "value", "near", "label").limit(LABELLED)
    rows = K.cut(few.withColumn("id", F.monotonically_increasing_id()))
    got = [list(map(float, r)) for r in covered(rows, words, ["id"]).select(*features().values(), "label", "id").collect()]  # LABELLED rows at most
    x = np.array(sorted(got, key=lambda r: r[-1])).reshape(-1, len(FEATURES) + 2)
    return forest(x[:, :-2], x[:, -2])


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (without the text) once per candidate, with value, near and after (the text beside it), doc_row and place (which identify it) and at (its first character, from 0)."""
    rest = [c for c in docs.columns if c != text]
    split = F.transform(F.split(text, CANDIDATE, -1), lambda s: F.struct(F.length(s).alias("n"), F.right(s, F.lit(NEAR)).alias("near"), F.left(s, F.lit(NEAR)).alias("after")))
    made = docs.where(F.col(text).rlike(CANDIDATE)).select(*rest, F.monotonically_increasing_id().alias("doc_row"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("_v"), split.alias("_s"))
    n = F.size("_v")
    zipped = F.arrays_zip(F.col("_v").alias("v"), F.slice("_s", F.lit(1), n).alias("s"), F.slice("_s", F.lit(2), n).alias("t"))
    each = made.select(*rest, "doc_row", F.posexplode(zipped).alias("place", "_x"))
    rows = K.cut(each.select(*rest, "doc_row", "place", F.col("_x.v").alias("value"), F.col("_x.s.near").alias("near"), F.col("_x.t.after").alias("after"), F.col("_x.s.n").cast("long").alias("_n")))
    before = F.sum(F.col("_n") + F.length("value")).over(Window.partitionBy("doc_row").orderBy("place"))
    return rows.withColumn("at", before - F.length("value")).drop("_n")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", least: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """(key, at, length, digest, score, secret) of every candidate; secret: the forest takes it for one. Values leave only as digests.

    ``labelled``: findings (value, near, after, path, label) to train from, LABELLED of them at most; by default the module's own.
    Null and empty texts have no candidates; a null path is no path; repeated rows each give theirs; other columns are left out.
    """
    words = K.cut(dictionary(docs, text))
    trees = trained(own_findings(docs.sparkSession, words) if labelled is None else labelled, words)
    found = candidates(docs.select(F.col(key).alias("key"), F.col(path).cast("string").alias("path"), F.col(text).alias("text")))
    scored = covered(found, words, ["doc_row", "place"]).select("key", "at", F.length("value").alias("length"), F.sha2("value", 256).alias("digest"), *(c.alias(f"f_{n}") for n, c in features().items()))
    scored = scored.withColumn("score", F.round(F.expr(expression(trees)), 6))
    return scored.select(F.col("key").alias(key), "at", "length", "digest", "score", (F.col("score") >= least).alias("secret"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(K.docs_of(spark, sf_dir))
