"""Quality by weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation estimates how often each rule is right from the
histogram of vote patterns over all documents (at most 3 ** rules rows, whatever the corpus), and the posterior
probability of being good, with the base limits, decides. The driver sees only that histogram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_stop long, n_upper long, n_letters long, n_lines long, n_marked long, n_distinct long"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*b"#*$%&|<>"]] = True
MARKS = SYMBOLS.copy()
MARKS[[*b"!"]] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LETTER = UPPER.copy()
LETTER[0x61:0x7B] = True
#: Frequent short words of English, German, French and Spanish.
STOP = "the of and to in is that it for with as was be by this are de la le les et des en que el los una del se las por con der die und das den von mit im ist nicht ein eine zu auf".split()
#: P(vote | class), classes bad and good, votes -1, 0, 1, before any document is seen.
PRIOR = [[0.35, 0.45, 0.2], [0.01, 0.44, 0.55]]
RULES = ("length", "symbols", "marks", "repeats", "lines", "stopwords", "upper", "variety")


def _word_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return K.hashes(raw, np.array([0]), np.array([len(raw)]), lower=False)[0]


def _runs(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return c[bounds[1:]] - c[bounds[:-1]]


def _again(key: np.ndarray, first_too: bool) -> np.ndarray:
    """Which places hold a value that an earlier place has, or that any other has."""
    order = np.argsort(key, kind=None if first_too else "stable")
    same = np.zeros(len(key) + 1, bool)
    v = key[order]
    same[1:-1] = v[1:] == v[:-1]
    out = np.zeros(len(key), bool)
    out[order] = same[:-1] | same[1:] if first_too else same[:-1]
    return out


def _own(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts also where their values are alike."""
    return h ^ K.mix(doc.astype(np.uint64) + K._M1)


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text, whole. Null is empty."""
    stop = np.sort(np.array([_word_hash(f(w)) for w in STOP for f in (str.lower, str.capitalize, str.upper)], np.uint64))
    parts = []
    for _, _, data, bounds in K.chunks(texts):
        starts, ends, of = K.words(data, bounds, K.SPACES)
        n = np.diff(of)
        doc = np.repeat(np.arange(len(n)), n)
        h = K.hashes(data, starts, ends, lower=False)
        inside = np.concatenate([[0], np.cumsum(K.SPACES[data] & ((data & 0xC0) != 0x80), dtype=np.int64)])
        three = K.windows(h, 3)
        whole = np.flatnonzero(np.arange(len(h)) + 3 <= of[1:][doc])
        twice = whole[_again(_own(doc[whole], three[whole]), True)]
        covered = np.zeros(len(h) + 2, bool)
        for k in range(3):
            covered[twice + k] = True
        nl = np.flatnonzero(data == 10)
        lo = np.sort(np.concatenate([bounds[:-1], nl + 1]))  # a line begins at each text and after each \n
        line_doc = np.searchsorted(bounds, lo, side="right") - 1
        hi = np.sort(np.concatenate([bounds[1:], nl]))
        worded = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
        lo, hi, line_doc = lo[worded], hi[worded], line_doc[worded]
        lines = K.hashes(data, lo, hi, lower=False)
        order = np.argsort(key := _own(doc, h))
        firsts = np.zeros(len(h), bool)
        firsts[order] = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(h) else False
        spot = np.minimum(np.searchsorted(stop, h), len(stop) - 1)
        count = lambda flags, where, m=len(n): np.bincount(where[flags], minlength=m)
        parts.append({
            "n_words": n, "word_chars": inside[bounds[1:]] - inside[bounds[:-1]], "n_symbols": _runs(SYMBOLS[data], bounds),
            "n_dup_lines": count(_again(_own(line_doc, lines), False), line_doc), "n_repeat_words": count(covered[: len(h)], doc),
            "n_stop": count(stop[spot] == h, doc), "n_upper": _runs(UPPER[data], bounds), "n_letters": _runs(LETTER[data], bounds),
            "n_lines": np.bincount(line_doc, minlength=len(n)), "n_marked": count(MARKS[data[ends - 1]] if len(h) else np.zeros(0, bool), doc), "n_distinct": count(firsts, doc),
        })
    names = [x.split()[0] for x in FEATURES.split(", ")]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def maas(f: dict[str, np.ndarray]) -> np.ndarray:
    """How much words repeat, by Maas' index, which hardly depends on a text's length: 0 if none repeats."""
    n = np.log(np.maximum(f["n_words"], 2))
    return (n - np.log(np.maximum(f["n_distinct"], 1))) / n**2


def votes(f: dict[str, np.ndarray]) -> np.ndarray:
    """[document, rule]: 1 good, -1 bad, 0 abstains: between the two bounds, and where a text is too short for a rule."""
    share = lambda a, b: f[a] / np.maximum(f[b], 1)
    n, lines, letters = f["n_words"], f["n_lines"], f["n_letters"]
    some, many = n >= 20, n >= 50
    sides = {
        "length": (n < 50, n >= 100),
        "symbols": (share("n_symbols", "n_words") > 0.1, some & (share("n_symbols", "n_words") <= 0.01)),
        "marks": (share("n_marked", "n_words") > 0.15, some & (share("n_marked", "n_words") <= 0.02)),
        "repeats": (2 * f["n_repeat_words"] > n, many & (10 * f["n_repeat_words"] <= n)),
        "lines": ((lines >= 4) & (3 * f["n_dup_lines"] > lines), (lines >= 4) & (f["n_dup_lines"] == 0)),
        "stopwords": (some & (share("n_stop", "n_words") < 0.02), some & (share("n_stop", "n_words") >= 0.1)),
        "upper": (share("n_upper", "n_letters") > 0.3, (letters >= 100) & (share("n_upper", "n_letters") <= 0.1)),
        "variety": (many & (maas(f) > 0.06), many & (maas(f) <= 0.03)),
    }
    return np.stack([np.where(bad, -1, np.where(good, 1, 0)) for bad, good in (sides[r] for r in RULES)], 1)


def pattern(f: dict[str, np.ndarray]) -> np.ndarray:
    """The votes as one number to base 3."""
    return (votes(f) + 1) @ (3 ** np.arange(len(RULES)))


def failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def fit(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) that occur ``counts`` times.

    Returns the share of good documents and each rule's P(vote | class), [rule, class (bad, good), vote (-1, 0, 1)].
    Starts from rules that catch a third of the bad documents and one in a hundred good ones, and keeps that prior with a fiftieth of the corpus's
    weight (ten documents at least): it anchors the classes' meaning, also on an empty or one-sided corpus.
    """
    n = patterns.shape[1]
    anchor = max(10.0, 0.02 * float(counts.sum()))
    prior = np.tile(np.array(PRIOR), (n, 1, 1))
    table, good, moved = prior.copy(), 0.7, np.inf
    while moved > 1e-9:  # each round raises the likelihood, so this ends
        p = posterior(patterns, good, table)
        weight = np.stack([counts * (1 - p), counts * p])
        new = anchor * prior
        for v in range(3):
            new[:, :, v] += (weight @ (patterns == v - 1)).T
        new /= new.sum(2, keepdims=True)
        was, good = good, (weight[1].sum() + 0.7 * anchor) / (weight.sum() + anchor)
        moved = abs(new - table).max() + abs(was - good)
        table = new
    return float(good), table


def posterior(patterns: np.ndarray, good: float, table: np.ndarray) -> np.ndarray:
    logs = np.log(np.array([1 - good, good]))[:, None] + np.zeros((2, len(patterns)))
    for r in range(patterns.shape[1]):
        logs += np.log(table[r][:, patterns[:, r] + 1])
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def verdicts(seen: DataFrame) -> np.ndarray:
    """The posterior of every possible pattern, from a table of pattern numbers of all documents."""
    rows = seen.groupBy("pattern").count().collect()  # at most 3 ** len(RULES) rows
    counts = np.zeros(3 ** len(RULES))
    for code, n in rows:
        counts[code] = n
    patterns = np.stack([np.arange(len(counts)) // 3**i % 3 - 1 for i in range(len(RULES))], 1)
    some = counts > 0
    return posterior(patterns, *fit(patterns[some], counts[some]))


def assess(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without its text, with the counts, base_failed, quality (posterior, rounded to 9 places) and kept.

    Nulls and empty texts have no words and fail the base limit; repeated rows stay, each judged alike; an empty table
    gives an empty result. Columns of ``docs`` that clash with those made here give way to them.
    """
    K.row_bytes(docs.sparkSession)
    made = {x.split()[0] for x in FEATURES.split(", ")} | {"base_failed", "quality", "kept", "pattern"}
    others = [c for c in docs.columns if c != text and c not in made]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in others)

    def each(batch: pa.RecordBatch) -> dict:
        f = features(batch.column(text))
        return {c: batch.column(c) for c in others} | f | {"base_failed": failed(f), "pattern": pattern(f)}

    rows = K.cut(K.map_batches(docs, [*others, text], f"{kinds}{FEATURES}, base_failed boolean, pattern int", each))
    judged = docs.sparkSession.createDataFrame([(i, round(float(p), 9)) for i, p in enumerate(verdicts(rows))], "pattern int, quality double")
    return rows.join(F.broadcast(judged), "pattern").drop("pattern").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``assess`` would keep, with their columns. The text is read twice and never shuffled."""
    K.row_bytes(docs.sparkSession)
    table = verdicts(K.map_batches(docs, [text], "pattern int", lambda batch: {"pattern": pattern(features(batch.column(0)))}))
    names, schema = docs.columns, docs.schema

    def each(batch: pa.RecordBatch) -> dict:
        f = features(batch.column(text))
        kept = batch.filter(pa.array(~failed(f) & (np.round(table[pattern(f)], 9) >= least)))
        return {c: kept.column(c) for c in names}

    return K.map_batches(docs, names, schema, each)


def query(spark, sf_dir: str) -> DataFrame:
    return assess(K.docs_of(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
