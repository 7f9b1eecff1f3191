"""What takes space: by kind, year, folder; largest items; tiles; empty folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import paths, values
from ..sources.catalog import outside


def by_kind(files: DataFrame) -> DataFrame:
    return files.where("kind <> 'link'").groupBy("kind").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


def by_year(files: DataFrame) -> DataFrame:
    """The year of the earlier of creation and modification, the latter from 1 ms after the epoch on."""
    when = F.least(F.coalesce("created_ms", "modified_ms"), F.greatest("modified_ms", F.lit(1)))
    return files.groupBy(values.year_of(when).cast("string").alias("year")).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


def rollup(files: DataFrame) -> DataFrame:
    """Bytes and files below each folder at any depth. Sizes are summed by parent before ancestors multiply rows."""
    direct = files.groupBy(paths.parent_of("path").alias("path")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    spread = direct.where("path <> ''").select(F.explode(paths.ancestors("path", itself=True)).alias("folder"), "b", "n")
    return spread.groupBy("folder").agg(F.sum("b").alias("bytes"), F.sum("n").alias("files"))


def largest(files: DataFrame, k: int, kind: str | None = None) -> DataFrame:
    """The k largest, ties by path; a bounded heap per task, no full sort."""
    rows = files.where(F.col("kind") == kind) if kind else files
    return rows.orderBy(F.desc("size"), "path").limit(k)


def tiles(files: DataFrame, base: str, top: int = 30) -> DataFrame:
    """(kind, name, bytes, items): child folders, the largest files of the folder itself, and one tile for the rest; with a column
    boundary, one for what private folders below hold."""
    if "boundary" in files.columns:
        hidden = files.where((F.lit(True) if not base else F.startswith(F.col("path"), F.lit(base + "/"))) & (F.col("boundary") > len(base)))
        shut = hidden.agg(F.sum("size").alias("bytes"), F.count("*").alias("items")).where("items > 0").select(F.lit("private").alias("kind"), F.lit("").alias("name"), "bytes", "items")
        return tiles(files.where(F.col("boundary") <= len(base)).drop("boundary"), base, top).union(shut)
    rel = F.col("path") if not base else F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path"))
    below = (files if not base else files.where(F.startswith(F.col("path"), F.lit(base + "/")))).withColumn("rel", rel)
    child = below.where(F.contains("rel", F.lit("/"))).groupBy(F.substring_index("rel", "/", 1).alias("name")).agg(F.sum("size").alias("bytes"), F.count("*").alias("items"))
    own = below.where(~F.contains("rel", F.lit("/")))
    shown = own.orderBy(F.desc("size"), "path").limit(top).select(F.lit("file").alias("kind"), F.col("rel").alias("name"), F.col("size").alias("bytes"), F.lit(1).cast("long").alias("items"))
    all_own = own.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n"))
    rest = all_own.join(shown.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("sb"), F.count("*").alias("sn")), how="full").where("n > sn")
    rest = rest.select(F.lit("rest").alias("kind"), F.lit("").alias("name"), (F.col("b") - F.col("sb")).alias("bytes"), (F.col("n") - F.col("sn")).alias("items"))
    return child.select(F.lit("folder").alias("kind"), "name", "bytes", "items").union(shown).union(rest)


def empty_folders(folders: DataFrame, files: DataFrame, private: DataFrame | None = None) -> DataFrame:
    """(path, nested): topmost folders without a file at any depth, and how many empty folders they hold. Folders in ``private`` (path) are left out, but files there count."""
    if private is not None:
        folders = outside(folders, private)
    used = files.select(F.explode(paths.ancestors("path")).alias("path")).distinct()
    empty = folders.select("path").join(used, "path", "left_anti")
    top = empty.join(empty.select(F.col("path").alias("parent")), paths.parent_of(empty["path"]) == F.col("parent"), "left_anti")
    inside = empty.select(F.explode(paths.ancestors("path")).alias("path")).join(top, "path", "left_semi").groupBy("path").agg(F.count("*").alias("nested"))
    return top.join(inside, "path", "left").select("path", F.coalesce("nested", F.lit(0)).alias("nested"))


def squarified(tiles_: list[tuple[str, float]], width: float, height: float) -> list[tuple[str, float, float, float, float]]:
    """(name, x, y, w, h) of one screen's tiles: rows are laid along the shorter side while that makes them squarer."""
    left = [(n, b) for n, b in sorted(tiles_, key=lambda t: (-t[1], t[0])) if b > 0]
    scale, x, y, w, h, out = width * height / sum(b for _, b in left) if left else 0.0, 0.0, 0.0, width, height, []
    while left:
        side, row, worst = min(w, h), [], float("inf")
        for n, b in left:
            areas = [a * scale for _, a in row] + [b * scale]
            s = sum(areas)
            now = max(max(side * side * max(areas) / (s * s), s * s / (side * side * min(areas))), 1.0)
            if row and now > worst:
                break
            row.append((n, b))
            worst = now
        left, thick, at = left[len(row) :], sum(b for _, b in row) * scale / side, 0.0
        for n, b in row:
            length = b * scale / thick
            out.append((n, x, y + at, thick, length) if w >= h else (n, x + at, y, length, thick))
            at += length
        x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
    return out


def all_tiles(files: DataFrame, top: int = 30) -> DataFrame:
    """(folder, kind, name, bytes, items) of every folder, "" at the top: its child folders with all below, its ``top`` largest files, and one tile for its other files."""
    below = rollup(files).where("folder <> ''")
    child = below.select(paths.parent_of("folder").alias("folder"), F.lit("folder").alias("kind"), paths.name_of("folder").alias("name"), "bytes", F.col("files").alias("items"))
    own = files.select(paths.parent_of("path").alias("folder"), "path", F.coalesce("size", F.lit(0)).alias("size"))
    order = Window.partitionBy("folder").orderBy(F.desc("size"), "path")
    shown = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = shown.select("folder", F.lit("file").alias("kind"), paths.name_of("path").alias("name"), F.col("size").alias("bytes"), F.lit(1).cast("long").alias("items"))
    sums = lambda rows, sign: rows.groupBy("folder").agg((sign * F.sum("size")).alias("bytes"), (sign * F.count("*")).alias("items"))
    rest = sums(own, 1).union(sums(shown, -1)).groupBy("folder").agg(F.sum("bytes").alias("bytes"), F.sum("items").alias("items")).where("items > 0")
    return child.union(named).union(rest.select("folder", F.lit("rest").alias("kind"), F.lit("").alias("name"), "bytes", "items"))


_TILE = "struct<kind: string, name: string, a: double>"
_RECT = "struct<kind: string, name: string, x: double, y: double, w: double, h: double>"


def _laid(s: str) -> str:
    """SQL: the state ``s`` with its row laid along the shorter side."""
    before = f"aggregate(slice({s}.row, 1, k), 0D, (n, r) -> n + r.a)"
    upright = f"transform({s}.row, (i, k) -> named_struct('kind', i.kind, 'name', i.name, 'x', {s}.x, 'y', {s}.y + {before} / ({s}.sum / {s}.h), 'w', {s}.sum / {s}.h, 'h', i.a / ({s}.sum / {s}.h)))"
    level = f"transform({s}.row, (i, k) -> named_struct('kind', i.kind, 'name', i.name, 'x', {s}.x + {before} / ({s}.sum / {s}.w), 'y', {s}.y, 'w', i.a / ({s}.sum / {s}.w), 'h', {s}.sum / {s}.w))"
    state = lambda x, y, w, h, rects: f"named_struct('x', {x}, 'y', {y}, 'w', {w}, 'h', {h}, 'sum', 0D, 'max', 0D, 'min', 0D, 'row', cast(array() as array<{_TILE}>), 'out', concat({s}.out, {rects}))"
    tall, flat = f"{s}.sum / {s}.h", f"{s}.sum / {s}.w"
    return f"IF({s}.w >= {s}.h, {state(f'{s}.x + {tall}', f'{s}.y', f'{s}.w - {tall}', f'{s}.h', upright)}, {state(f'{s}.x', f'{s}.y + {flat}', f'{s}.w', f'{s}.h - {flat}', level)})"


def layouts(tiles_: DataFrame, width: float, height: float) -> DataFrame:
    """(folder, kind, name, x, y, w, h) of all folders' tiles (folder, kind, name, bytes): rectangles as ``squarified`` lays them, the
    largest first, ties by kind and name. Each folder's tiles are folded in their order in one expression; those of no bytes have none."""
    item = F.struct((-F.col("bytes")).alias("b"), "kind", "name")
    rows = tiles_.where("bytes > 0").groupBy("folder").agg(F.array_sort(F.collect_list(item)).alias("found"), F.sum("bytes").alias("total"))
    area = width * height
    rows = rows.withColumn("tiles", F.expr(f"transform(found, f -> named_struct('kind', f.kind, 'name', f.name, 'a', -f.b * {area}D / total))"))
    worst = lambda side, top, low, total: f"greatest({side} * {side} * {top} / ({total} * {total}), {total} * {total} / ({side} * {side} * {low}))"
    side = "least(s.w, s.h)"
    grown = "named_struct('x', {0}.x, 'y', {0}.y, 'w', {0}.w, 'h', {0}.h, 'sum', {0}.sum + i.a, 'max', IF(size({0}.row) = 0, i.a, {0}.max), 'min', i.a, 'row', concat({0}.row, array(i)), 'out', {0}.out)"
    fits = f"size(s.row) = 0 OR {worst(side, 's.max', 'i.a', '(s.sum + i.a)')} <= {worst(side, 's.max', 's.min', 's.sum')}"
    begin = f"named_struct('x', 0D, 'y', 0D, 'w', {float(width)}D, 'h', {float(height)}D, 'sum', 0D, 'max', 0D, 'min', 0D, 'row', cast(array() as array<{_TILE}>), 'out', cast(array() as array<{_RECT}>))"
    step = f"IF({fits}, {grown.format('s')}, transform(array({_laid('s')}), t -> {grown.format('t')})[0])"
    made = F.expr(f"aggregate(tiles, {begin}, (s, i) -> {step}, s -> {_laid('s')}.out)")
    return rows.select("folder", F.inline(made))


def ranked(files: DataFrame, by: str, *keys) -> DataFrame:
    return files.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*keys)))
