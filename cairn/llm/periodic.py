"""Periodic runs of words, by the linear-time method of Gusfield and Stoye for tandem repeats.

A text's words are numbered and sorted by suffix (names of all stretches of 2, 4, 8 ... words give the suffix array, common
prefixes and common suffixes). The suffix tree is that array with its common prefixes: a point on an edge is an interval of the
array and a length. LZ blocks give squares that cover the leftmost of each kind; from their places walks along suffix links mark
every kind; the occurrences below each marked point merge into runs. Every step works on all blocks, walks and points at once.

Only stretches of words covered by 6-word windows that recur in their text are looked at: both parts of a run of at least 12
words that lie a period apart are such, and they cover the run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from . import kernel as K

#: The shortest run, and half of it.
LEAST, HALF = 12, 6
#: Words of stretches that are looked at together; a longer stretch is alone. About 200 bytes a word.
TOGETHER = 200_000


class Suffixes:
    """Suffix array of numbered words, with the names of all stretches of a power of two."""

    def __init__(self, ids: np.ndarray):
        self.n = n = len(ids)
        self.names = [ids.astype(np.int64)]
        width = 1
        while n and self.names[-1].max() < n - 1:  # names are dense: all differ then
            low = self.names[-1]
            high = np.zeros(n, np.int64)  # 0: the text ends before
            high[: max(0, n - width)] = low[width:] + 1
            pair = low * (n + 1) + high
            order = np.argsort(pair, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], pair[order][1:] != pair[order][:-1]]))
            self.names.append(new)
            width *= 2
        self.rank = self.names[-1]
        self.order = np.argsort(self.rank, kind="stable")
        self.common = np.zeros(n + 1, np.int64)  # of the suffixes at k - 1 and k in the order; 0 at both ends
        if n > 1:
            self.common[1:n] = self.forward(self.order[:-1], self.order[1:])
        self.least: list[np.ndarray] | None = None

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the texts from a and from b (another place) on have in common."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            name = self.names[j]
            same = np.flatnonzero((np.maximum(a, b) < self.n) & (name[np.minimum(a, self.n - 1)] == name[np.minimum(b, self.n - 1)]))
            for x in (a, b, out):
                x[same] += 1 << j
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the texts up to a and up to b, both included, have in common at their ends."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            name, w = self.names[j], (1 << j) - 1
            same = np.flatnonzero((np.minimum(a, b) >= w) & (name[np.maximum(a - w, 0)] == name[np.maximum(b - w, 0)]))
            a[same] -= 1 << j
            b[same] -= 1 << j
            out[same] += 1 << j
        return out

    def points(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval [first, after) of the order below the point that spells ``length`` words from ``at``."""
        if self.least is None:
            self.least, low = [self.common], int(length.min(initial=1))
            while len(self.least[-1]) > (1 << (len(self.least) - 1)) and self.least[-1].max() >= low:
                last, w = self.least[-1], 1 << (len(self.least) - 1)
                self.least.append(np.minimum(last[:-w], last[w:]))
        left, right = self.rank[at].copy(), self.rank[at] + 1
        for j in range(len(self.least) - 1, -1, -1):
            level, w = self.least[j], 1 << j
            go = np.flatnonzero((left - w + 1 >= 0) & (level[np.clip(left - w + 1, 0, len(level) - 1)] >= length))
            left[go] -= w
            go = np.flatnonzero((right < len(level)) & (level[np.minimum(right, len(level) - 1)] >= length))
            right[go] += w
        return left, right

    def blocks(self) -> np.ndarray:
        """Starts of the LZ blocks: each the longest prefix of the rest that also starts earlier, or one new word."""
        n, order = self.n, self.order.tolist()
        before, after, stack = [-1] * n, [-1] * n, []
        for p in order:  # the nearest earlier place on both sides in the order
            while stack and stack[-1] > p:
                after[stack.pop()] = p
            before[p] = stack[-1] if stack else -1
            stack.append(p)
        longest = np.zeros(n, np.int64)
        for other in (np.array(before, np.int64), np.array(after, np.int64)):
            has = np.flatnonzero(other >= 0)
            longest[has] = np.maximum(longest[has], self.forward(has, other[has]))
        step, starts, i = np.maximum(longest, 1).tolist(), [], 0
        while i < n:
            starts.append(i)
            i += step[i]
        return np.array(starts, np.int64)


def _merged(first: np.ndarray, after: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (first, after, period) sorted, one for each stretch: that of the smallest period."""
    rows = np.stack([first, after, period], 1)
    rows = rows[np.lexsort((period, after, first))]
    return rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])] if len(rows) else rows


def _counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whose, 0, 1, ... for each)."""
    whose = np.repeat(np.arange(len(sizes)), sizes)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def repetitions(ids: np.ndarray) -> np.ndarray:
    """Rows (first, after, smallest period) of all maximal stretches of at least twice their smallest period; ids are 0, 1, ... without gaps."""
    n = len(ids)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    tree = Suffixes(ids)
    # Squares whose centre or second half meets a block's bounds, by block and period.
    start = tree.blocks()
    after = np.append(start[1:], n)
    size = after - start
    following = np.append(size[1:], 0)
    found = []
    for bound, most, ahead in ((after, size, False), (start, size + following, True)):
        whose, k = _counted(most)
        k += 1
        h = bound[whose]
        q = h + k if ahead else h - k
        ok = (q >= 0) & (q <= n) & (h <= n)
        h, q, k = h[ok], q[ok], k[ok]
        near = (np.maximum(h, q) < n) & (ids[np.minimum(h, n - 1)] == ids[np.minimum(q, n - 1)])
        near |= (np.minimum(h, q) > 0) & (ids[np.maximum(h - 1, 0)] == ids[np.maximum(q - 1, 0)])
        h, q, k = h[near], q[near], k[near]
        ahead_of, behind = tree.forward(h, q), tree.backward(h - 1, q - 1)
        ok = ahead_of + behind >= k
        found.append(((np.minimum(h, q) - behind)[ok], (np.maximum(h, q) + ahead_of)[ok], k[ok]))
    runs = _merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
    if not len(runs):
        return runs
    # A suffix link leads from a square to that which starts one word later, while the run goes on: all kinds of a run by its first period.
    whose, step = _counted(np.minimum(runs[:, 2], runs[:, 1] - runs[:, 0] - 2 * runs[:, 2] + 1))
    at, k = runs[whose, 0] + step, runs[whose, 2]
    rank = tree.rank[at]
    more = np.flatnonzero(np.maximum(tree.common[rank], tree.common[rank + 1]) >= 2 * k)  # others stand nowhere else
    at, k = at[more], k[more]
    if len(at):
        left, right = tree.points(at, 2 * k)
        marks = np.unique(np.stack([left, right, k], 1), axis=0)
        whose, step = _counted(marks[:, 1] - marks[:, 0])
        place, k = tree.order[marks[whose, 0] + step], marks[whose, 2]
        first, last = place - tree.backward(place - 1, place + k - 1), place + k + tree.forward(place, place + k)
        runs = _merged(np.concatenate([runs[:, 0], first]), np.concatenate([runs[:, 1], last]), np.concatenate([runs[:, 2], k]))
    return runs


def _covered(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the stretches of words that windows of HALF words cover which recur in their text."""
    whole = np.flatnonzero(np.arange(len(h)) + HALF <= at[1:][doc])
    if not len(whole):
        return whole, whole
    key = K.mix(K.windows(h, HALF)[whole] + doc[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = np.concatenate([[False], key[order][1:] == key[order][:-1], [False]])
    again = whole[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(h) + 1, np.int32)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + HALF, -1)
    inside = np.cumsum(cover[:-1]) > 0
    joined = np.concatenate([[False], inside[1:] & inside[:-1] & (doc[1:] == doc[:-1]), [False]])
    return np.flatnonzero(inside & ~joined[:-1]), np.flatnonzero(inside & ~joined[1:]) + 1


def runs_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (first, after, period), sorted, of the runs of LEAST words or more in texts whose words' hashes are h; text i has words at[i] to at[i + 1]."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    starts, ends = _covered(h, doc, at)
    keep = ends - starts >= LEAST
    starts, ends = starts[keep], ends[keep]
    out, i = [np.zeros((0, 3), np.int64)], 0
    total = np.cumsum(ends - starts)
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + TOGETHER, side="right")))
        whose, step = _counted(ends[i:j] - starts[i:j])
        place = starts[i:j][whose] + step
        # Words of different stretches are different symbols, so that nothing is found across them.
        _, ids = np.unique(K.mix(h[place] + (whose + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_inverse=True)
        found = repetitions(ids.astype(np.int64))
        found = found[found[:, 1] - found[:, 0] >= np.maximum(LEAST, 2 * found[:, 2])]
        out.append(np.stack([place[found[:, 0]], place[found[:, 1] - 1] + 1, found[:, 2]], 1))
        i = j
    rows = np.concatenate(out)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: runs (start, length, period) by start and period, word numbers from 0.

    A run is a stretch of at least LEAST words and twice its smallest period that no neighbour extends. ``collapsed`` has the words
    that no run contains after its first period, joined by one space. Words are parted by ASCII white space. Null and empty texts
    have no words; rows that repeat are treated alike; null keys stay; other columns are not read; an empty table gives no rows.
    Texts that are not UTF-8 are taken byte by byte.
    """
    K.row_bytes(docs.sparkSession)
    made = StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    schema = StructType([StructField("key", docs.schema[key].dataType), *made.fields])

    def run(batches):
        for batch in K.tidied(batches):
            for i, j, data, bounds in K.chunks(batch.column(1)):
                first, last, at = K.words(data, bounds, K.SPACES)
                found = runs_of(K.hashes(data, first, last, lower=False), at)
                kept, per = [b" ".join(data[a:b].tobytes().split()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.searchsorted(found[:, 0], at)
                for d in np.flatnonzero(np.diff(per)).tolist():
                    gone = np.zeros(int(at[d + 1] - at[d]) + 1, np.int32)
                    mine = found[per[d] : per[d + 1]]
                    np.add.at(gone, mine[:, 0] + mine[:, 2] - at[d], 1)
                    np.add.at(gone, mine[:, 1] - at[d], -1)
                    words = kept[d].split(b" ")
                    kept[d] = b" ".join([words[x] for x in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])
                own = found[:, 0] - np.repeat(at[:-1], np.diff(per))
                each = pa.StructArray.from_arrays([pa.array(own), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], ["start", "length", "period"])
                _, offsets, flat = pa.array(kept, pa.binary()).buffers()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(at)),
                        pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), each),
                        pa.StringArray.from_buffers(len(kept), offsets, flat),
                    ],
                    names=schema.names,
                )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; one document in ten, by the checksum of its id, has its words from some place on repeat with some period."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    made = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    made = made.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("IF(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    turned = F.expr("array_join(transform(sequence(0, n - 1), i -> w[IF(i < a, i, CAST(a + (i - a) % p AS INT))]), ' ')")
    return made.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    found = runs(planted(K.docs_of(spark, sf_dir)))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    made = found.withColumn("top", top).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")))
    return made.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
