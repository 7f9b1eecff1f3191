"""Language identification of whole, possibly mixed-language texts.

A model of byte trigrams per language is fitted on a bounded sample of labelled rows, whole; tasks count, the driver gets the counts. For each word, the scripts of
its letters narrow the languages, trigrams score those that stay, and a Viterbi pass over the words, with a penalty for
each switch, labels spans. A document's language is the one whose spans hold most letters; its score their share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import kernel as K

#: Rows of each language that the model is fitted on at most (those of the smallest crc32 of their id).
SAMPLE = 400
SLOTS = 1 << 16
#: Log-probability lost by changing the language between two words.
SWITCH = 12.0
#: First code points of scripts' ranges, and the scripts (0: common). Latin letters beyond ASCII are cut in blocks of 16.
RANGES = [
    (0x00, 0), (0xC0, 1), (0xD0, 2), (0xE0, 3), (0xF0, 4), (0x100, 5), (0x180, 6), (0x250, 0), (0x370, 7), (0x400, 8), (0x530, 9), (0x590, 10), (0x600, 11),
    (0x900, 12), (0x980, 13), (0xA00, 14), (0xB80, 15), (0xE00, 16), (0xE80, 0), (0x10A0, 17), (0x1100, 18), (0x1200, 19), (0x13A0, 0), (0x1E00, 20),
    (0x1F00, 7), (0x2000, 0), (0x3040, 21), (0x3100, 0), (0x3400, 22), (0xA000, 0), (0xAC00, 18), (0xD7B0, 0), (0xF900, 22), (0xFB00, 0),
]
SCRIPTS = 23
_FIRST, _SCRIPT = np.array([x[0] for x in RANGES]), np.array([x[1] for x in RANGES])
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Words: runs of ASCII letters and of bytes of other characters.
_WORD = _ASCII_LETTER.copy()
_WORD[0x80:] = True


def _lead_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and code points of characters beyond ASCII (four-byte ones count as script 0)."""
    at = np.flatnonzero(data >= 0xC2)
    lead = data[at].astype(np.int64)
    end = len(data) - 1
    b1, b2 = data[np.minimum(at + 1, end)].astype(np.int64) & 63, data[np.minimum(at + 2, end)].astype(np.int64) & 63
    return at, np.where(lead < 0xE0, (lead & 31) << 6 | b1, np.where(lead < 0xF0, (lead & 15) << 12 | b1 << 6 | b2, 0x2000))


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all byte trigrams (a word's borders are spaces), the byte runs they belong to as bounds, and each word's scripts as bits."""
    low = K.LOWER[data].astype(np.uint32)
    n = ends - starts
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(starts - bounds[:-1], n) + np.arange(bounds[-1])
    mid = low[at]
    before, after = low[np.maximum(at - 1, 0)], low[np.minimum(at + 1, max(len(low) - 1, 0))]
    before[bounds[:-1]] = 32
    after[bounds[1:] - 1] = 32
    slot = ((before * np.uint32(0x9E3779B1)) ^ (mid * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    place, point = _lead_points(data)
    script = _SCRIPT[np.searchsorted(_FIRST, point, side="right") - 1]
    bits = np.zeros(len(starts), np.int64)
    word = np.searchsorted(starts, place, side="right") - 1
    inside = (word >= 0) & (script > 0)
    if inside.any():
        inside &= place < ends[np.maximum(word, 0)]
        np.bitwise_or.at(bits, word[inside], 1 << script[inside].astype(np.int64))
    return slot, bounds, bits


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """How often each slot occurs, how many words have letters of each script, and the number of words."""
    counts, scripts, total = np.zeros(SLOTS, np.int64), np.zeros(SCRIPTS, np.int64), 0
    for _, _, data, bounds in K.chunks(texts):
        starts, ends, _ = K.words(data, bounds, _WORD)
        if len(starts):
            slot, _, bits = _grams(data, starts, ends)
            counts += np.bincount(slot, minlength=SLOTS)
            scripts += [(bits >> s & 1).sum() for s in range(SCRIPTS)]
            total += len(starts)
    return counts, scripts, total


class Model:
    """Languages, [slot, language] log-probabilities and [script, language]: whether a language has letters of it."""

    def __init__(self, samples: dict[str, list[str]]):
        self._set({lang: _counted(pa.array(texts, pa.string())) for lang, texts in samples.items()})

    @classmethod
    def of(cls, counted: dict[str, tuple[np.ndarray, np.ndarray, int]]) -> Model:
        m = cls.__new__(cls)
        m._set(counted)
        return m

    def _set(self, counted: dict) -> None:
        self.langs = sorted(counted)
        counts = np.zeros((SLOTS, len(self.langs)))
        share = np.zeros((SCRIPTS, len(self.langs)))
        for k, lang in enumerate(self.langs):
            counts[:, k], scripts, total = counted[lang]
            share[:, k] = scripts / max(total, 1)
        self.logs = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * SLOTS)).astype(np.float32)
        self.has = share > 0.0005


def spans(texts: pa.Array, model: Model) -> list[tuple[np.ndarray, ...]]:
    """For each run of texts: (first text, bounds of words by text, starts, ends, language numbers of words, letters of words)."""
    out, many = [], len(model.langs)
    for i, _, data, bounds in K.chunks(texts, K.CHUNK * 4 // max(8, many)):
        starts, ends, of = K.words(data, bounds, _WORD)
        n = np.diff(of)
        if not len(starts) or not many:
            out.append((i, of, starts, ends, np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)))
            continue
        slot, runs, bits = _grams(data, starts, ends)
        score = np.empty((len(starts), many), np.float32)
        for k in range(many):
            score[:, k] = np.add.reduceat(model.logs[:, k][slot], runs[:-1])
        for s in range(1, SCRIPTS):  # a language without a word's script is no candidate, unless none has it
            if len(which := np.flatnonzero(bits >> s & 1)) and model.has[s].any():
                score[which[:, None], np.flatnonzero(~model.has[s])] -= 1e4
        state = _viterbi(score, of[:-1], n)
        letters = np.add.reduceat(_ASCII_LETTER[data] | (data >= 0xC2), np.stack([starts, ends], 1).ravel()[: -1 if ends[-1] >= len(data) else None])[::2]
        out.append((i, of, starts, ends, state, letters))
    return out


def _viterbi(score: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best language of each word; all texts advance together, word by word, longest texts first."""
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    total, many = score.shape
    number = np.min_scalar_type(-max(many, 1))  # holds every language's number
    back = np.empty((total, many), number)
    best = np.zeros((len(n), many), np.float32)
    rows = np.arange(many, dtype=number)
    steps = [int(np.searchsorted(-n, -k, side="left")) for k in range(int(n[0]) if len(n) else 0)]  # texts of over k words
    for k, m in enumerate(steps):
        at = first[:m] + k
        top = best[:m].argmax(1)
        jump = best[np.arange(m), top] - np.float32(SWITCH if k else 0)
        stay = best[:m] >= jump[:, None]
        back[at] = np.where(stay, rows, top[:, None])
        best[:m] = np.where(stay, best[:m], jump[:, None]) + score[at]
        best[:m] -= best[:m].max(1, keepdims=True)
    out = np.empty(total, np.int64)
    state = best.argmax(1)
    for k in range(len(steps) - 1, -1, -1):
        m = steps[k]
        at = first[:m] + k
        out[at] = state[:m]
        state[:m] = back[at, state[:m]]
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of ``docs``' non-null languages, from ``sample`` rows of each at most (a documented bound), whole.

    The driver gets a count of rows and one of trigrams for each language, no text.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    hashed = F.crc32(F.col(key).cast("string").cast("binary"))
    counts = rows.groupBy(lang).count().collect()  # a row per language
    if not counts:
        return Model({})
    # Rows whose hash lies below a language's share; half as many again are asked for, so that enough come.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], int(min(2**32, 2**32 * (1.5 * sample + 50) / r[1])))])
    few = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), hashed.alias("h")).where(F.coalesce("h", F.lit(0)) < share[F.col("lang")])
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))).where(F.col("n") <= sample)

    def each(batch: pa.RecordBatch) -> dict:
        found = {}
        for name in set(batch.column(0).to_pylist()):
            slots, scripts, total = _counted(batch.filter(pc.equal(batch.column(0), name)).column(1))
            used = np.flatnonzero(slots)
            found[name] = used.astype(np.uint16).tobytes(), slots[used].astype(np.uint32).tobytes(), scripts.tobytes(), total
        cols = list(zip(*found.values(), strict=True)) or [[]] * 4
        return {"lang": list(found)} | dict(zip(("slots", "counts", "scripts", "words"), map(list, cols), strict=True))

    K.row_bytes(docs.sparkSession)
    summed: dict[str, tuple] = {r[0]: (np.zeros(SLOTS, np.int64), np.zeros(SCRIPTS, np.int64), 0) for r in counts}
    for r in K.map_batches(few, ["lang", "text"], "lang string, slots binary, counts binary, scripts binary, words long", each).toLocalIterator():
        slots, scripts, total = summed[r.lang]
        slots[np.frombuffer(r.slots, np.uint16)] += np.frombuffer(r["counts"], np.uint32)
        summed[r.lang] = slots, scripts + np.frombuffer(r.scripts, np.int64), total + r.words
    return Model.of(summed)


def label(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: lang_pred, score, and spans (start and end in words, language).

    Null texts and texts without a letter are ``und`` with score 0 and no span; so is everything if no language was learned.
    Repeated rows each give a row; other columns are left out.
    """
    K.row_bytes(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS floats a language

    def each(batch: pa.RecordBatch) -> dict:
        m, texts = held.value, batch.column(1)
        pred, score, runs = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in range(len(texts))]
        for i, of, starts, _, state, letters in spans(texts, m):
            n = len(of) - 1
            doc = np.repeat(np.arange(n), np.diff(of))
            if not len(starts) or not m.langs:
                continue
            by = np.bincount(doc * len(m.langs) + state, weights=letters, minlength=n * len(m.langs)).reshape(n, -1)
            cuts = np.concatenate([[0], np.flatnonzero((state[1:] != state[:-1]) | (doc[1:] != doc[:-1])) + 1])
            stops = np.concatenate([cuts[1:], [len(state)]])
            for a, b in zip(cuts.tolist(), stops.tolist(), strict=True):
                d = doc[a]
                runs[i + d].append((a - int(of[d]), b - int(of[d]), m.langs[state[a]]))
            for d in np.flatnonzero(by.sum(1) > 0).tolist():
                pred[i + d], score[i + d] = m.langs[int(by[d].argmax())], round(float(by[d].max() / by[d].sum()), 6)
        for d, t in enumerate(K.texts(texts)):
            if pred[d] != "und" and not _has_letter(t):
                pred[d], score[d], runs[d] = "und", 0.0, []
        return {key: batch.column(0), "lang_pred": pred, "score": score, "spans": [[{"first": a, "last": b, "lang": c} for a, b, c in r] for r in runs]}

    return K.map_batches(docs, [key, text], f"`{key}` {kind}, lang_pred string, score double, spans array<struct<first: int, last: int, lang: string>>", each)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def query(spark, sf_dir: str) -> DataFrame:
    docs = K.docs_of(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit(docs.where(~held_out))
    return label(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
