"""N-gram Jaccard join with filters of several global token orders, exact for every pair.

Texts become sets of word shingles (48-bit tokens); equal sets are one node. Two nodes of similarity t or more share
a token in their prefixes (n - ceil(t n) + 1 tokens) under *any* global order, so candidates must share one under each of
``ORDERS`` orders, and the filters are intersected before verification. All orders put rare tokens first.

Plan: (1) tokens go, packed, to buckets of the token space; a bucket sees every node of its tokens and drops tokens of
a single node. Hot tokens, which more than one node in ``HOT`` holds, are counted while the sets are made and go past the
buckets with that count. (2) What is left goes to buckets of nodes: a node with more single tokens than the similarity lets it
miss can link with nothing and is dropped; the others' prefixes are known. (3) Nodes of one batch that share prefix tokens are
tied to the smallest of them there; then each batch sends a token once, with that node, to token buckets, where a token ties
the batches' nodes to one, and a bucket emits a tree of its nodes, not pairs. (4) Nodes in one component under every order form
a cell; only nodes of one cell can be linked. (5) A cell is searched breadth first: a node's candidates share a prefix token
under each order, have a fitting size and are not reached yet; they are verified by counting common tokens. So a group of
copies costs a verification per member, not per pair. Large cells are split into blocks; all meet the first, and what is not in
one component then meets all.
Shuffles carry packed arrays (about 6 bytes a token); joins on a node, root or cell broadcast the right rows of hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K
from .components import components

SHINGLE, ORDERS, BITS = 5, 3, 48
#: Tokens in a bucket or a block on average; a task holds a few times that.
BUCKET = 3_000_000
_PLANES = BITS // 8
#: A token is hot if more than one in HOT nodes holds it, so there are at most HOT times as many as a node has on average; beyond
#: HOT_TOKENS of them the rarer ones go the usual way.
HOT, HOT_TOKENS = 1024, 1 << 20


def _node_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes and node ids (a sum of scrambled tokens; 0 if empty) of all texts; then (text's number, token), sorted."""
    sizes, nodes, docs, tokens = [], [], [], []
    for i, j, data, bounds in K.chunks(texts):
        starts, ends, of = K.words(data, bounds, K.SPACES)
        doc, h = K.shingles(K.hashes(data, starts, ends), of, k)
        n = np.bincount(doc, minlength=j - i)
        total = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(h ^ K._M3), dtype=np.uint64)])
        at = np.concatenate([[0], np.cumsum(n)])
        sizes.append(n)
        nodes.append(np.where(n > 0, K.mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)), 0).view(np.int64))
        docs.append((doc + i).astype(np.int32))
        tokens.append(h >> np.uint64(64 - BITS))
    if not sizes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return np.concatenate(sizes), np.concatenate(nodes), np.concatenate(docs), np.concatenate(tokens)


def _planes(x: np.ndarray) -> bytes:
    """Sorted values as differences, byte plane by byte plane, without planes that are all zero; they compress well."""
    d = np.diff(x, prepend=np.uint64(0))
    n = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([n]) + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    n = raw[0]
    p = np.frombuffer(raw, np.uint8, offset=1).reshape(n, -1)
    d = np.zeros((p.shape[1], 8), np.uint8)
    d[:, :n] = p.T
    return np.cumsum(d.view(np.uint64).ravel(), dtype=np.uint64)


def _small(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :_PLANES]).tobytes()


def _large(raw: bytes) -> np.ndarray:
    d = np.zeros((len(raw) // _PLANES, 8), np.uint8)
    d[:, :_PLANES] = np.frombuffer(raw, np.uint8).reshape(-1, _PLANES)
    return d.view(np.uint64).ravel()


def _runs(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def _bucketed(tokens: np.ndarray, shift: int, **columns: np.ndarray) -> Iterator[tuple[int, np.ndarray, dict]]:
    order = np.argsort(tokens)
    tokens = tokens[order]
    bucket = tokens >> np.uint64(shift)
    cuts = _runs(bucket)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), tokens[a:b], {k: v[order[a:b]] for k, v in columns.items()}


def sets(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_shingles, node) of every row and the columns ``also``; the node is null for an empty set.

    Also __often, on the first row of a batch: the tokens that many of the batch's nodes hold, and how many do."""
    K.row_bytes(docs.sparkSession)
    kind = lambda c: docs.schema[c].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> dict:
        n, node, doc, token = _node_sets(batch.column(1), k)
        often: list = [None] * len(n)
        if len(n):
            one = _first_of_each(node)
            held, count = np.unique(token[one[doc]], return_counts=True)
            many = count >= max(4, one.sum() // (HOT // 4))
            often[0] = held[many].tobytes() + count[many].tobytes()
        return {key: batch.column(0), "n_shingles": n, "node": pa.array(node, mask=n == 0), "__often": pa.array(often, pa.binary())} | {c: batch.column(2 + i) for i, c in enumerate(also)}

    return K.map_batches(docs, [key, text, *also], ", ".join([f"`{key}` {kind(key)}, n_shingles long, node long, __often binary", *(f"`{c}` {kind(c)}" for c in also)]), each)


def _first_of_each(node: np.ndarray) -> np.ndarray:
    """Marks one text of each node, so that copies within a batch count once."""
    one = np.zeros(len(node), bool)
    one[np.unique(node, return_index=True)[1]] = True
    return one


def hot_tokens(of: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hot tokens, sorted, and about how many nodes hold each, from ``sets``. HOT_TOKENS at most come to the driver.

    A token that more than one in HOT nodes holds is held by as many in some batch, so its batches' counts make up most of its nodes."""
    def each(batch: pa.RecordBatch) -> dict:
        parts = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in batch.column(0).to_pylist()]
        tokens, counts = np.concatenate(parts, 1) if parts else np.zeros((2, 0), np.uint64)
        tokens, where = np.unique(tokens, return_inverse=True)
        return {"token": tokens.view(np.int64), "n": np.bincount(where, counts, len(tokens)).astype(np.int64)}

    nodes = of.select(F.count("node")).first()[0]
    found = K.map_batches(of.where("octet_length(__often) > 0"), ["__often"], "token long, n long", each).groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") > max(4, nodes / HOT)).orderBy(F.desc("n"), "token").limit(HOT_TOKENS).toArrow()
    token, n = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(token)
    return token[order], np.minimum(n[order], 65535).astype(np.uint16)


def _home(node: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of a node."""
    return (K.mix(node.view(np.uint64)) >> np.uint64(64 - max(bits, 1))).astype(np.int64) if bits else np.zeros(len(node), np.int64)


def _by_home(node: np.ndarray, size: np.ndarray, own: np.ndarray, token: np.ndarray, df: np.ndarray, bits: int) -> list[tuple]:
    """Rows (bucket, nodes, sizes, counts, tokens, dfs) of tokens by their nodes (``own``: places in ``node``)."""
    order = np.lexsort((own, _home(node, bits)[own]))
    token, own, df = token[order], own[order], df[order]
    home = _home(node, bits)[own]
    cuts, rows = _runs(home), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        ends = _runs(own[a:b])
        held = own[a:b][ends[:-1]]
        rows.append((int(home[a]), node[held].tobytes(), size[held].tobytes(), np.diff(ends).astype(np.uint32).tobytes(), _small(token[a:b]), df[a:b].tobytes()))
    return rows


_BY_HOME = ("bucket", "nodes", "sizes", "counts", "tokens", "dfs")


def _scattered(docs: DataFrame, text: str, k: int, bits: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Step 1, before the shuffle: by token bucket (nodes, sizes, tokens, at), or, under -1 - bucket of nodes, hot tokens as ``_by_home``."""
    shift, held_hot = BITS - bits, docs.sparkSession.sparkContext.broadcast(hot)  # 10 bytes for each of HOT_TOKENS at most

    def scatter(batches):
        often, times = held_hot.value
        for batch in K.tidied(batches):
            n, node, doc, token = _node_sets(batch.column(0), k)
            keep = _first_of_each(node)[doc]
            doc, token = doc[keep], token[keep]
            rows = []
            if len(often):
                spot = np.minimum(np.searchsorted(often, token), len(often) - 1)
                is_hot = often[spot] == token
                for home, *packed in _by_home(node, n.astype(np.uint32), doc[is_hot], token[is_hot], times[spot[is_hot]], bits):
                    rows.append((-1 - home, *packed))
                doc, token = doc[~is_hot], token[~is_hot]
            for bucket, tokens, c in _bucketed(token, shift, doc=doc):
                held, at = np.unique(c["doc"], return_inverse=True)
                rows.append((bucket, node[held].tobytes(), n[held].astype(np.uint32).tobytes(), None, _planes(tokens), at.astype(np.uint16 if len(held) < 65536 else np.uint32).tobytes()))
            for i in range(0, len(rows), 64):
                yield _rows(rows[i : i + 64], *_BY_HOME)

    return docs.select(text).mapInArrow(scatter, "bucket long, nodes binary, sizes binary, counts binary, tokens binary, dfs binary")


def _shared_tokens(docs: DataFrame, text: str, k: int, bits: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Steps 1: for buckets of nodes, packed (nodes, sizes, counts, tokens, document frequencies) of tokens that two nodes have."""
    def gather(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket < 0:
            return table.set_column(0, "bucket", pa.array(np.full(len(table), -1 - bucket)))
        nodes, sizes, tokens, owner, base = [], [], [], [], 0
        for x in table.to_pylist():
            node, t = np.frombuffer(x["nodes"], np.int64), _unplanes(x["tokens"])
            nodes.append(node)
            sizes.append(np.frombuffer(x["sizes"], np.uint32))
            tokens.append(t)
            owner.append(np.frombuffer(x["dfs"], np.uint16 if len(node) < 65536 else np.uint32).astype(np.int64) + base)
            base += len(node)
        node, first, where = np.unique(np.concatenate(nodes), return_index=True, return_inverse=True)
        size, token, own = np.concatenate(sizes)[first], np.concatenate(tokens), where[np.concatenate(owner)].astype(np.int32)
        order = np.lexsort((own, token))
        token, own = token[order], own[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (own[1:] != own[:-1])])
        token, own = token[new], own[new]
        cuts = _runs(token)
        df = np.repeat(np.diff(cuts), np.diff(cuts))
        shared = df > 1
        return pa.Table.from_batches([_rows(_by_home(node, size, own[shared], token[shared], np.minimum(df[shared], 65535).astype(np.uint16), bits), *_BY_HOME)])

    return _scattered(docs, text, k, bits, hot).groupBy("bucket").applyInArrow(gather, "bucket long, nodes binary, sizes binary, counts binary, tokens binary, dfs binary")


def _rows(rows: list[tuple], *names: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(cols)], list(names))


def _prefixed(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Step 2: (node, n, tokens by the first order, p: bytes of the prefix's places in it under each order)."""

    def run(table: pa.Table) -> pa.Table:
        parts = [[], [], [], []]
        for x in table.to_pylist():
            count = np.frombuffer(x["counts"], np.uint32)
            parts[0].append(np.repeat(np.frombuffer(x["nodes"], np.int64), count))
            parts[1].append(np.repeat(np.frombuffer(x["sizes"], np.uint32), count))
            parts[2].append(_large(x["tokens"]))
            parts[3].append(np.frombuffer(x["dfs"], np.uint16))
        node, n, token, df = (np.concatenate(p) for p in parts)
        order = np.lexsort((token, df, node))
        node, n, token, df = node[order], n[order].astype(np.int64), token[order], df[order]
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (token[1:] != token[:-1])])  # a hot token comes from each batch with the node
        node, n, token, df = node[new], n[new], token[new], df[new]
        cuts = _runs(node)
        lengths, size = np.diff(cuts), n[cuts[:-1]]
        spare = size - -(-num * size // den)  # tokens that a similar set may lack
        prefix = spare + 1 - (size - lengths)  # single tokens come first in every order
        at = np.arange(len(node)) - np.repeat(cuts[:-1], lengths)
        places = []
        rarity = np.frexp(df.astype(np.float32))[1]
        group = np.repeat(np.arange(len(lengths)), lengths)
        for r in range(1, ORDERS):
            order = np.lexsort((K.mix(token ^ np.uint64(r * 0x5851F42D4C957F2D)), rarity, group))
            places.append(at[order].astype(np.uint32))
        rows = [(int(node[a]), int(size[i]), int(prefix[i]), _small(token[a:b]), *(p[a : a + prefix[i]].tobytes() for p in places)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if prefix[i] > 0]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * (4 + ORDERS - 1)
        return pa.Table.from_arrays([pa.array(list(c), pa.int64() if i < 3 else pa.binary()) for i, c in enumerate(cols)], ["node", "n", "prefix", "tokens", *(f"p{r}" for r in range(1, ORDERS))])

    return shared.groupBy("bucket").applyInArrow(run, "node long, n long, prefix long, tokens binary" + "".join(f", p{r} binary" for r in range(1, ORDERS)))


def _prefix_tokens(row: dict) -> list[np.ndarray]:
    t = _large(row["tokens"])
    return [t[: row["prefix"]], *(t[np.frombuffer(row[f"p{r}"], np.uint32)] for r in range(1, ORDERS))]


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the smallest one that edges a-b lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tree(token: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes that tokens tie together: edges (a, b) from each node to the smallest of its component, and for each token, sorted, that node."""
    order = np.argsort(token, kind="stable")
    token, own = token[order], own[order]
    cuts = _runs(token)
    node, own = np.unique(own, return_inverse=True)
    least = _least(own, np.repeat(own[cuts[:-1]], np.diff(cuts)), len(node))
    far = np.flatnonzero(least != np.arange(len(node)))
    return node[far], node[least[far]], token[cuts[:-1]], node[least[own[cuts[:-1]]]]


def _tied(nodes: DataFrame) -> DataFrame:
    """Step 3, before the shuffle: by bucket and order (tokens, own), or, under negative buckets, the batch's own edges."""
    tokens = nodes.select(F.sum("prefix")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, tokens / BUCKET)))))
    shift = BITS - bits

    def scatter(batches):
        for batch in K.tidied(batches):
            owners: list[list] = [[] for _ in range(ORDERS)]
            tokens: list[list] = [[] for _ in range(ORDERS)]
            for row in batch.to_pylist():
                for r, t in enumerate(_prefix_tokens(row)):
                    tokens[r].append(t)
                    owners[r].append(np.full(len(t), row["node"]))
            rows = []
            for r in range(ORDERS):
                if tokens[r]:
                    a, b, token, own = _tree(np.concatenate(tokens[r]), np.concatenate(owners[r]))
                    if len(a):
                        rows.append((-1 - (int(_home(a[:1], bits)[0]) * ORDERS + r), a.tobytes(), b.tobytes()))
                    for bucket, t, c in _bucketed(token, shift, own=own):
                        rows.append((bucket * ORDERS + r, _planes(t), c["own"].tobytes()))
            yield _rows(rows, "bucket", "tokens", "own")

    return nodes.mapInArrow(scatter, "bucket long, tokens binary, own binary")


def _stars(nodes: DataFrame) -> DataFrame:
    """Step 3: (k, a, b): under order k, prefix tokens of one batch or bucket lead from node a to b, the smallest such node.

    The buckets follow the number of prefix tokens, and a bucket says once what its tokens say together."""
    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        if bucket < 0:
            a, b = (np.concatenate([np.frombuffer(x[c], np.int64) for x in rows]) for c in ("tokens", "own"))
        else:
            a, b, *_ = _tree(np.concatenate([_unplanes(x["tokens"]) for x in rows]), np.concatenate([np.frombuffer(x["own"], np.int64) for x in rows]))
        return pa.table({"k": np.full(len(a), (bucket if bucket >= 0 else -1 - bucket) % ORDERS), "a": a, "b": b})

    return _tied(nodes).groupBy("bucket").applyInArrow(gather, "k long, a long, b long")


def search(rows: list[dict], num: int, den: int) -> list[tuple[int, int]]:
    """Step 5: (node, root) of all nodes of a cell's block that links join to another; roots are nodes."""
    m = len(rows)
    size = np.array([x["n"] for x in rows])
    own = [_large(x["tokens"]) for x in rows]
    count = np.array([len(t) for t in own])
    at = np.concatenate([[0], np.cumsum(count)])
    alike, tokens = np.unique(np.concatenate(own), return_inverse=True)
    indexes = []
    for r, lists in enumerate(zip(*(_prefix_tokens(x) for x in rows), strict=True)):
        ids = [np.searchsorted(alike, t) for t in lists]
        flat, who = np.concatenate(ids), np.repeat(np.arange(m), [len(x) for x in ids])
        order = np.argsort(flat, kind="stable")
        indexes.append((ids, np.searchsorted(flat[order], np.arange(len(alike) + 1)), who[order]))
    free = np.ones(m, bool)
    marked = np.zeros(len(alike), bool)
    out: list[tuple[int, int]] = []
    for root in range(m):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        for x in queue:
            left = np.flatnonzero(free & (den * size >= num * size[x]) & (den * size[x] >= num * size))
            if not len(left):
                continue
            ids, lo, who = indexes[0]
            if count[left].sum() > (lo[ids[x] + 1] - lo[ids[x]]).sum():  # else it is cheaper to verify all that are left
                for ids, lo, who in indexes:
                    hit = np.zeros(m, bool)
                    a, b = lo[ids[x]], lo[ids[x] + 1]
                    n = b - a
                    hit[who[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]] = True
                    left = left[hit[left]]
                if not len(left):
                    continue
            marked[tokens[at[x] : at[x + 1]]] = True
            n = count[left]
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            common = np.add.reduceat(marked[tokens[np.repeat(at[left] - begin, n) + np.arange(n.sum())]].astype(np.int64), begin)
            marked[tokens[at[x] : at[x + 1]]] = False
            linked = left[den * common >= num * (size[left] + size[x] - common)]
            free[linked] = False
            queue += linked.tolist()
        if len(queue) > 1:
            out += [(rows[x]["node"], rows[root]["node"]) for x in queue]
    return out


def node_components(docs: DataFrame, of: DataFrame, text: str = "text", k: int = SHINGLE, num: int = 3, den: int = 4) -> DataFrame:
    """(v, root) of the nodes that links of similarity num / den or more join; ``of``: the table of ``sets`` of ``docs``."""
    K.row_bytes(docs.sparkSession)
    tokens = of.select(F.sum("n_shingles")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, tokens / BUCKET)))))
    nodes = K.cut(_prefixed(_shared_tokens(docs, text, k, bits, hot_tokens(of)), num, den))
    found = components(K.cut(_stars(nodes)), ["k"])
    cells = found.groupBy("v").agg(*(F.max(F.when(F.col("k") == r, F.col("root"))).alias(f"c{r}") for r in range(ORDERS)))
    cells = cells.where(" AND ".join(f"c{r} IS NOT NULL" for r in range(ORDERS))).select(F.col("v").alias("node"), F.xxhash64(*(f"c{r}" for r in range(ORDERS))).alias("cell"))
    weighed = K.cut(cells.join(nodes.select("node", (F.length("tokens") / _PLANES).cast("long").alias("w")), "node"))
    sums = weighed.groupBy("cell").agg(F.sum("w").alias("w"), F.count("*").alias("m")).where("m > 1")
    sums = K.cut(sums.select("cell", F.ceil(F.col("w") / (BUCKET // 2)).alias("blocks")))
    groups = max(1, int((weighed.select(F.sum("w")).first()[0] or 0) / BUCKET) * 2)
    placed = K.cut(K.spread_join(weighed, sums, ["cell"]).withColumn("i", F.pmod(F.xxhash64("node"), "blocks")))

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        cuts = _runs(table["cell"].to_numpy())
        out = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1 for x in search(table.slice(a, b - a).to_pylist(), num, den)]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    def found_in(places: DataFrame) -> DataFrame:
        return K.cut(places.join(nodes, "node").groupBy("place").applyInArrow(links, "a long, b long"))

    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    at = lambda *c: F.concat_ws("/", "cell", *c)
    # A cell of one block shares a group with others; of a larger one, each block meets the first.
    shared = placed.where("blocks = 1").select("node", "cell", F.pmod("cell", F.lit(groups)).cast("string").alias("place"))
    large = placed.where("blocks > 1")
    first = large.select("node", "cell", F.explode(F.when(F.col("i") == 0, F.transform(F.filter(upto("blocks"), lambda j: j > 0), lambda j: at(j))).otherwise(F.array(at("i")))).alias("place"))
    edges = found_in(shared.union(first))
    if large.isEmpty():
        return components(edges)
    # What one component of a cell holds by now, as a group of near copies does, need not meet itself; all others meet the whole cell.
    known = K.cut(large.join(components(edges).select(F.col("v").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    main = known.groupBy("cell", "root").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    told = K.cut(K.spread_join(known, main, ["cell"]).withColumn("other", F.col("root") != F.col("main")))
    rest = told.where("other").groupBy("cell").agg(F.ceil(F.sum("w") / (BUCKET // 2)).alias("parts"))
    both = K.spread_join(told, rest, ["cell"]).withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), "parts"))
    across = F.transform(upto("parts"), lambda j: at(j, F.col("i")))
    along = F.when(F.col("other"), F.transform(upto("blocks"), lambda i: at(F.col("j"), i))).otherwise(F.array().cast("array<string>"))
    return components(edges.union(found_in(both.select("node", "cell", F.explode(F.array_union(across, along)).alias("place")))))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, num: int = 3, den: int = 4) -> DataFrame:
    """One row per document: key, n_shingles and component_id, the smallest key that links lead to, its own included.

    Null and empty texts have no shingles and are linked with nothing; equal sets and repeated rows are linked; an empty
    table gives an empty result; other columns are left out.
    """
    of = K.cut(sets(docs, key, text, k))
    linked = node_components(docs, of, text, k, num, den).select(F.col("v").alias("node"), "root")
    some = of.where("node IS NOT NULL").select(key, "n_shingles", "node")
    classes = K.cut(some.groupBy("node").agg(F.min(key).alias("least")).join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = K.cut(K.spread_join(classes, least, ["root"]).select("node", "component_id"))
    found = K.spread_join(some, named, ["node"]).select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))
    return found.union(of.where("node IS NULL").select(key, "n_shingles", F.col(key).alias("component_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the smallest key; a null key comes after all others.

    Documents without shingles all stay. A key says nothing about groups: rows are known by key and text, so that null and
    repeated keys neither lose nor keep a document. Rows equal in a key and text are one document and stay together; null
    is no key, so of such rows with it one stays.
    """
    marked = docs.select(key, text, F.xxhash64(text).alias("__pair_hash"))
    of = K.cut(sets(marked, key, text, also=("__pair_hash",)))
    linked = node_components(docs, of, text).select(F.col("v").alias("node"), "root")
    least = F.min(F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("__its_key"), "__pair_hash"))
    nodes = of.where("node IS NOT NULL").groupBy("node").agg(least.alias("first")).join(linked, "node", "left")
    first = nodes.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.*")
    single = of.where("node IS NULL").select(F.col(key).alias("__its_key"), "__pair_hash", F.lit(False).alias("no_key")).distinct()
    kept = K.cut(first.select("__its_key", "__pair_hash", "no_key").union(single).withColumnRenamed("__pair_hash", "__its_hash"))
    stay = lambda d, k: d.join(k, F.col(key).eqNullSafe(F.col("__its_key")) & (F.xxhash64(text) == F.col("__its_hash")), "left_semi")
    out = stay(docs, kept.where("NOT no_key").drop("no_key"))
    nameless = kept.where("no_key").drop("no_key")
    if not nameless.isEmpty():
        out = out.unionByName(stay(docs.where(F.col(key).isNull()), nameless).dropDuplicates([text]))
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return join(K.docs_of(spark, sf_dir).select("doc_id", "text"))
