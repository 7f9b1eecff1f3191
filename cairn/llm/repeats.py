"""Repeated byte strings across documents, by merging shards' Burrows-Wheeler transforms.

1. Candidates. Each string of ``span`` bytes is assigned to its least ``GRAM``-byte stretch (by a hash; the last of equals), which
   depends on the string alone. Neighbouring strings of one stretch are a context. Equal contexts hold equal strings: all but the
   first go whole. Contexts of a stretch that stands in one context only hold strings that stand nowhere else. All others are merged.
2. Shards. Every batch of texts deals its contexts by their stretch and sorts the suffixes of each share: a transform and the ranks
   of the contexts' first suffixes; nothing else of the text is shuffled.
3. Merge. A share's transforms are merged by refining their interleaving: each round moves every suffix to the one that starts
   earlier, stably by the signs it gains, so that after rounds for d bytes suffixes lie in order of d bytes and a bound between two
   blocks appears in the round of their common prefix. A block of one suffix is settled and leaves; blocks left after ``span`` bytes
   are repeated intervals. Suffixes are sorted in shards alone, never again.

Contexts of a stretch with many different contexts (an edge of a passage that many documents share) are dealt string by string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, ShortType, StructField, StructType

from ..session import numbered
from . import kernel as K

SPAN, GRAM = 100, 40
#: Bytes of text for each group of stretches, and suffixes for each group of contexts.
STRETCHES, SUFFIXES = 4 << 20, 4_000_000
#: Contexts of one stretch above which each string of them is dealt on its own.
SPLIT = 1000
#: Strings looked at together when contexts are found.
STEP = 1 << 17
REMOVE, SINGLE = -1, -2

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _packed(*columns: np.ndarray) -> bytes:
    """The columns byte by byte, compressed; of one length each two."""
    n = [len(c) for c in columns]
    planes = [c.reshape(-1, 1).view(np.uint8).T.tobytes() if c.itemsize > 1 and len(c) else c.tobytes() for c in columns]
    return np.array(n, np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(blob: bytes, kinds: str) -> list[np.ndarray]:
    kinds = [np.dtype(k) for k in kinds.split()]
    n = np.frombuffer(blob, np.int64, len(kinds))
    flat, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 * len(kinds) :]), np.uint8), 0, []
    for k, m in zip(kinds, n.tolist(), strict=True):
        part = flat[at : at + m * k.itemsize]
        out.append(np.ascontiguousarray(part.reshape(k.itemsize, m).T).view(k).ravel() if k.itemsize > 1 else part.view(k))
        at += m * k.itemsize
    return out


def _stretches(x: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each place on; the last places have no meaning."""
    h = (x.astype(np.uint64) + np.uint64(1)) * _M1
    h ^= h >> np.uint64(29)
    have = 1
    while have < width:
        step = min(have, width - have)
        wide = h * _M2
        wide[: len(h) - step] += h[step:]
        wide ^= wide >> np.uint64(31)
        h, have = wide, have + step
    return K.mix(h)


def contexts(data: np.ndarray, bounds: np.ndarray, span: int = SPAN, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash of the stretch, text's number, first string, last string) of the contexts of texts; strings by their first bytes."""
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    left = bounds[1:][doc] - np.arange(len(data)) >= span
    for s in range(0, len(data), STEP):
        x = data[s : s + STEP + span - 1]
        if len(x) < span:
            return
        h = _stretches(x, gram)
        top = np.uint64(0xFFFFFF)
        least = h & ~top | (top - np.arange(len(x), dtype=np.uint64))  # the last of equal ones is the least
        have, width = 1, span - gram + 1
        while have < width:
            step = min(have, width - have)
            wide = least.copy()
            np.minimum(least[: len(x) - step], least[step:], out=wide[: len(x) - step])
            least, have = wide, have + step
        p = np.flatnonzero(left[s : s + STEP][: max(0, len(x) - span + 1)])
        if not len(p):
            continue
        at = (top - (least[p] & top)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)]))
        first = p[new]
        last = p[np.append(new[1:], len(p)) - 1]
        yield h[at[new]], doc[first + s], first + s, last + s


def transform(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transform of the strings data[first:first + size], each with an end that sorts before all bytes, and their ranks.

    The ends' suffixes come first, in the order of the strings. The sign before a whole string has no meaning.
    """
    whole = size + 1
    at = np.cumsum(whole) - whole
    total = int(whole.sum())
    inner = np.arange(total) - np.repeat(at, whole)
    rest = np.repeat(size, whole) - inner
    text = data[np.minimum(np.repeat(first, whole) + inner, len(data) - 1)]
    word, padded = np.zeros(total, np.uint64), np.concatenate([text, np.zeros(8, np.uint8)])
    for j in range(7):
        word |= padded[j : j + total].astype(np.uint64) << np.uint64(56 - 8 * j)
    have = np.minimum(rest, 7).astype(np.uint64)
    word &= np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(8) * (np.uint64(8) - have) - np.uint64(1)) << np.uint64(1)
    word |= have
    order = np.argsort(word, kind="stable")
    new = np.concatenate([[True], word[order][1:] != word[order][:-1]])
    slots, block, depth = np.arange(total), np.cumsum(new), 7
    while True:
        alone = new & np.append(new[1:], True)
        held = order[slots]
        go = np.flatnonzero(~alone & (rest[held] >= depth))  # equal ones that have ended stay in the order of their strings
        if not len(go):
            break
        slots, block, held = slots[go], block[go], held[go]
        key = word[held + depth]
        by = np.lexsort((key, block))
        order[slots] = held[by]
        key, block = key[by], block[by]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        block, depth = np.cumsum(new), depth + 7
    rank = np.empty(total, np.int32)
    rank[order] = np.arange(total, dtype=np.int32)
    return text[order - 1], rank[at]


def _back(bwt: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For each suffix the rank of that which starts one sign earlier; 0 for whole strings."""
    inner = np.ones(len(bwt), bool)
    inner[ranks] = False
    at = np.flatnonzero(inner)
    out = np.zeros(len(bwt), np.int32)
    out[at[np.argsort(bwt[at], kind="stable")]] = np.arange(len(ranks), len(bwt), dtype=np.int32)
    return out


def repeated(shards: list[tuple[np.ndarray, np.ndarray]], extra: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, string, place) of the suffixes whose first ``span`` bytes stand more than once; string i, of all shards' strings in
    their order, is looked at in places 0 to extra[i] and has span + extra[i] bytes."""
    back, signs, ends, at = [], [], [], 0
    for bwt, ranks in shards:
        back.append(_back(bwt, ranks) + np.int32(at))
        signs.append(bwt)
        ends.append(np.arange(len(ranks), dtype=np.int32) + np.int32(at))
        at += len(bwt)
    back, signs, here = np.concatenate(back), np.concatenate(signs), np.concatenate(ends)
    # The suffixes that start where looked-at strings end, reached from the ends of the contexts.
    suffix, whose, place, live = [], [], [], np.arange(len(extra))
    for j in range(int(extra.max(initial=-1)) + 1):
        live = live[extra[live] >= j]
        suffix.append(here[live])
        whose.append(live)
        place.append(extra[live] - j)
        here[live] = back[here[live]]
    suffix, own = np.concatenate(suffix), np.arange(sum(map(len, suffix)), dtype=np.int32)
    pair, two = signs[back].astype(np.uint16) << np.uint16(8) | signs, back[back]
    block, done = np.zeros(len(suffix), np.int32), 0
    while done < span and len(suffix):
        wide = 2 if span - done > 1 else 1
        sign = (pair if wide == 2 else signs)[suffix]
        order = np.argsort(sign, kind="stable")
        sign, block = sign[order], block[order]
        suffix, own = (two if wide == 2 else back)[suffix[order]], own[order]
        new = np.empty(len(order) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(sign[1:], sign[:-1], out=new[1:-1])
        new[1:-1] |= block[1:] != block[:-1]
        block = np.cumsum(new[:-1], dtype=np.int32)
        keep = np.flatnonzero(~(new[:-1] & new[1:]))
        if len(keep) < len(order):
            suffix, own, block = suffix[keep], own[keep], block[keep]
        done += wide
    return block, np.concatenate(whose)[own], np.concatenate(place)[own]


def _later(group: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows stand later than the first of their group, by (key, at); group is sorted, and rows in it by (key, at)."""
    new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(group) else np.zeros(0, np.int64)
    return (key != key[first]) | (at != at[first])


def _shares(docs: DataFrame, groups: int, span: int) -> DataFrame:
    """(part, later, blob): contexts of a batch by the group of their stretch, each once; and places of contexts that stand earlier in the batch."""

    def run(batches):
        for batch in K.tidied(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found: list[list[np.ndarray]] = []
            for i, _, data, bounds in K.chunks(batch.column(1)):
                raw = data.tobytes()
                for k, doc, first, last in contexts(data, bounds, span):
                    c = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (last + span).tolist(), strict=True)), np.uint64, len(first))
                    found.append([k, c, ids[doc + i], (first - bounds[doc]).astype(np.int32), (last - first).astype(np.uint8)])
            if not found:
                continue
            k, c, key, at, extra = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((at, key, c))
            later = np.zeros(len(order), bool)
            later[order] = _later(c[order], key[order], at[order])
            first = np.zeros(len(order), bool)
            first[order] = np.concatenate([[True], c[order][1:] != c[order][:-1]])
            for kind, rows in ((False, np.flatnonzero(first)), (True, np.flatnonzero(later))):
                part = (k[rows] % np.uint64(groups)).astype(np.int64) if not kind else np.arange(len(rows)) * groups // max(1, len(rows))
                rows = rows[np.argsort(part, kind="stable")]
                part.sort()
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
                blobs = []
                for x in np.split(rows, cut[1:]) if len(rows) else []:
                    places = np.diff(key[x], prepend=0), at[x], extra[x]
                    blobs.append(_packed(*places) if kind else _packed((k[x] >> np.uint64(32)).astype(np.uint32), c[x], *places))
                yield pa.RecordBatch.from_arrays([pa.array(part[cut] if len(rows) else part), pa.array(np.full(len(blobs), kind)), pa.array(blobs, pa.binary())], ["part", "later", "blob"])

    return docs.mapInArrow(run, "part long, later boolean, blob binary")


def _decide(table: pa.Table) -> pa.Table:
    """(key, at, extra, goal) of a group's contexts: REMOVE, SINGLE or the stretch by which it is dealt; nothing of others."""
    rows: list[list[np.ndarray]] = [[np.zeros(0, x) for x in (np.uint32, np.uint64, np.int64, np.int32, np.uint8)]]
    out = []
    for later, blob in zip(table["later"].to_pylist(), table["blob"].to_pylist(), strict=True):
        if later:
            key, at, extra = _unpacked(blob, "i8 i4 u1")
            out.append((np.cumsum(key), at, extra, np.full(len(at), REMOVE)))
        else:
            k, c, key, at, extra = _unpacked(blob, "u4 u8 i8 i4 u1")
            rows.append([k, c, np.cumsum(key), at, extra])
    k, c, key, at, extra = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((at, key, c, k))
    k, c, key, at, extra = (x[order] for x in (k, c, key, at, extra))
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
    gone = _later(np.cumsum(new), key, at)
    out.append((key[gone], at[gone], extra[gone], np.full(int(gone.sum()), REMOVE)))
    k, key, at, extra = k[new], key[new], at[new], extra[new]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else new
    many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(k) else np.zeros(0, np.int64)
    part = table["part"][0].as_py() << 32
    goal = np.where(many > SPLIT, SINGLE, part | k.astype(np.int64))
    out.append((key[many > 1], at[many > 1], extra[many > 1], goal[many > 1]))
    key, at, extra, goal = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"key": key, "at": at.astype(np.int32), "extra": extra.astype(np.int32), "goal": goal.astype(np.int64)})


def _transforms(docs: DataFrame, groups: int, span: int) -> DataFrame:
    """(part, blob): the transforms of each batch's contexts; docs has key, text and contexts (at, extra, goal)."""

    def run(batches):
        for batch in K.tidied(batches):
            data, bounds = K.buffers(batch.column(1))
            each, counts = batch.column(2).flatten(), np.diff(batch.column(2).offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), counts)
            at, extra, goal = (x.to_numpy() for x in each.flatten())
            at = at.astype(np.int64)
            single = np.flatnonzero(goal == SINGLE)
            whose = np.repeat(single, extra[single] + 1)
            step = np.arange(len(whose)) - np.repeat(np.cumsum(extra[single] + 1) - extra[single] - 1, extra[single] + 1)
            one, raw = bounds[doc[whose]] + at[whose] + step, data.tobytes()
            string = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + span]) for a in one.tolist()), np.uint64, len(one))
            kept = np.flatnonzero(goal != SINGLE)
            deal = K.mix(np.concatenate([goal[kept].astype(np.uint64), string])) % np.uint64(groups)
            doc, at, extra = np.concatenate([doc[kept], doc[whose]]), np.concatenate([at[kept], at[whose] + step]), np.concatenate([extra[kept], np.zeros(len(whose), np.int32)])
            order = np.argsort(deal, kind="stable")
            deal = deal[order]
            cut = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1]])) if len(deal) else []
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for p, x in zip(deal[cut].tolist(), np.split(order, cut[1:]), strict=True) if len(deal) else ():
                bwt, ranks = transform(data, bounds[doc[x]] + at[x], extra[x].astype(np.int64) + span)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([_packed(bwt, ranks, ids[doc[x]], at[x], extra[x].astype(np.uint8))], pa.binary())], ["part", "blob"])

    return docs.mapInArrow(run, "part long, blob binary")


def _merge(table: pa.Table, span: int) -> pa.Table:
    """(key, at, extra) of the strings of a group that stand earlier, neighbours together."""
    shards, own = [], []
    for blob in table["blob"].to_pylist():
        bwt, ranks, key, at, extra = _unpacked(blob, "u1 i4 i8 i8 u1")
        shards.append((bwt, ranks))
        own.append((key, at, extra.astype(np.int64)))
    key, at, extra = (np.concatenate(x) for x in zip(*own, strict=True))
    block, string, place = repeated(shards, extra, span)
    k, a = key[string], at[string] + place
    order = np.lexsort((a, k, block))
    gone = order[_later(block[order], k[order], a[order])]
    gone = gone[np.lexsort((place[gone], string[gone]))]
    s, p = string[gone], place[gone]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)])) if len(s) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(s)))
    return pa.table({"key": key[s[new]], "at": (at[s[new]] + p[new]).astype(np.int32), "extra": (size - 1).astype(np.int32)})


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(own, key, text): own is the key where that is a whole number, given and different in every row, else the row's number by key and text."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    whole = isinstance(docs.schema[key].dataType, (IntegerType, LongType, ShortType))
    if whole and rows.groupBy("key").count().where("count > 1 OR key IS NULL").isEmpty():
        return rows.select(F.col("key").cast("long").alias("own"), "key", "text")
    return numbered(rows, [F.asc_nulls_first("key"), F.asc_nulls_first("text")], "own")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(key, n_bytes, spans, kept) of every row: the maximal spans (start, length) of bytes covered by strings of ``span`` bytes that
    also start earlier (in a row of a smaller key, or further left in the row), and the bytes that are left.

    Null and empty texts have no bytes; texts shorter than ``span`` keep all. Rows that repeat a key are texts of their own, in the
    order of the texts, so of repeated rows one stays; null keys come first. Other columns are not read. Any bytes will do. An
    empty table gives no rows. ``span`` is from GRAM + 1 to GRAM + 250.
    """
    if not GRAM < span <= GRAM + 250:
        raise ValueError(f"strings of {GRAM + 1} to {GRAM + 250} bytes can be looked for")
    K.row_bytes(docs.sparkSession)
    rows = _keyed(docs, key, text)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shares = _shares(rows.select("own", "text"), total // STRETCHES + 1, span)
    found = K.cut(shares.groupBy("part").applyInArrow(_decide, "key long, at int, extra int, goal long"))
    open_ = found.where(F.col("goal") != REMOVE)
    strings = F.when(F.col("goal") == SINGLE, (F.col("extra") + 1) * F.lit(span + 1)).otherwise(F.col("extra") + span + 1).cast("long")
    suffixes = open_.agg(F.coalesce(F.sum(strings), F.lit(0))).first()[0]
    per_doc = open_.groupBy(F.col("key").alias("own")).agg(F.collect_list(F.struct("at", "extra", "goal")).alias("contexts"))
    shards = _transforms(rows.join(per_doc, "own").select("own", "text", "contexts"), suffixes // SUFFIXES + 1, span)
    merged = shards.groupBy("part").applyInArrow(lambda t: _merge(t, span), "key long, at int, extra int")
    gone = found.where(F.col("goal") == REMOVE).select("key", "at", "extra").union(merged)
    spans = gone.groupBy(F.col("key").alias("own")).agg(F.collect_list(F.struct("at", "extra")).alias("gone"))
    return _without(rows.join(spans, "own", "left").select("key", "text", "gone"), docs.schema[key], span).withColumnRenamed("key", key)


def _without(docs: DataFrame, key: StructField, span: int) -> DataFrame:
    made = StructType.fromDDL("n_bytes long, spans array<struct<start: long, length: long>>, kept binary")
    schema = StructType([StructField("key", key.dataType), *made.fields])

    def run(batches):
        for batch in K.tidied(batches):
            data, bounds = K.buffers(batch.column(1))
            raw, kept, offsets, start, length = data.tobytes(), [], [0], [], []
            lists = batch.column(2)
            counts = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
            at, extra = (x.to_numpy() for x in lists.flatten().flatten())
            cut = np.concatenate([[0], np.cumsum(counts)])
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if not counts[i]:
                    kept.append(raw[a:b])
                else:
                    first = at[cut[i] : cut[i + 1]].astype(np.int64)
                    order = np.argsort(first)
                    first, last = first[order], np.maximum.accumulate((first + extra[cut[i] : cut[i + 1]] + span)[order])
                    new = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]]))
                    s, e = first[new].tolist(), last[np.append(new[1:], len(first)) - 1].tolist()
                    kept.append(b"".join(raw[a + x : a + y] for x, y in zip([0, *e], [*s, b - a], strict=True)))
                    start += s
                    length += [y - x for x, y in zip(s, e, strict=True)]
                offsets.append(len(start))
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64())], ["start", "length"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), spans, pa.array(kept, pa.binary())], schema.names)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return dedup(K.docs_of(spark, sf_dir)).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
