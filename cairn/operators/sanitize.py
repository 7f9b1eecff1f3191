"""Copies of images without metadata, by rewriting the container: pixels are never decoded. No Python.

A walk over a file's chunks or segments (``aggregate`` over as many steps as there may be, at most ``STEPS``) finds the ranges that
define the image, by lists of what may stay. The orientation, if it turns the picture, stays as a minimal Exif block. A second walk
over the copy confirms that the same ranges are in it and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Chunks that stay.
PNG_KEEP = "IHDR PLTE IDAT IEND tRNS gAMA cHRM sRGB iCCP sBIT pHYs bKGD hIST acTL fcTL fdAT cICP mDCv cLLi".split()
WEBP_KEEP = ["VP8X", "VP8 ", "VP8L", "ALPH", "ICCP", "ANIM", "ANMF"]
#: The most chunks and bytes of a file that is cleaned.
STEPS, BYTES = 65_536, 60 << 20
#: Fixed value: a TIFF block with one field, the orientation, before and after its value.
BEFORE, AFTER = "4D4D002A0000000800010112000300000001", "000000000000"


def _int(start: str, n: int, little: bool = False) -> str:
    """SQL: the number in ``n`` bytes from ``start`` (1-based); null beyond the end."""
    part = f"substring(c, cast({start} as int), {n})"
    hexed = f"hex({part})" if not little else f"concat({', '.join(f'substring(hex({part}), {2 * k + 1}, 2)' for k in reversed(range(n)))})"
    return f"IF(length({part}) = {n}, cast(conv({hexed}, 16, 10) as bigint), null)"


def _text(start: str, n: int) -> str:
    return f"decode(substring(c, cast({start} as int), {n}), 'ISO-8859-1')"


def _let(values: dict[str, str], body: str) -> str:
    """SQL: ``body`` with x.name for each value, worked out once."""
    return f"transform(array(named_struct({', '.join(f'{k!r}, {v}' for k, v in values.items())})), x -> {body})[0]"


def _state(at: str = "s.at", phase: str = "s.phase", insert: str = "s.insert", exif: str = "s.exif", kept: str = "s.kept") -> str:
    return f"named_struct('at', cast({at} as bigint), 'phase', {phase}, 'insert', cast({insert} as bigint), 'exif', {exif}, 'kept', {kept})"


def _keep(start: str, size: str) -> str:
    """SQL: the ranges with one more; neighbours become one, but for where something is put in between."""
    one = f"array(named_struct('at', cast({start} as bigint), 'size', cast({size} as bigint)))"
    last = "element_at(s.kept, -1)"
    longer = f"concat(slice(s.kept, 1, size(s.kept) - 1), array(named_struct('at', {last}.at, 'size', {last}.size + {size})))"
    return f"CASE WHEN {size} <= 0 THEN s.kept WHEN size(s.kept) > 0 AND {last}.at + {last}.size = {start} AND {start} <> coalesce(s.insert, -1) THEN {longer} ELSE concat(s.kept, {one}) END"


def _png() -> str:
    names = ", ".join(map(repr, PNG_KEEP))
    new = _state("s.at + 12 + x.n", "IF(x.kind = 'IEND', 'done', 'go')", "IF(x.kind = 'IHDR' AND s.insert IS NULL, s.at + 12 + x.n, s.insert)", "IF(x.kind = 'eXIf' AND s.exif IS NULL, substring(c, cast(s.at + 8 as int), cast(x.n as int)), s.exif)", f"IF(x.kind IN ({names}), {_keep('s.at', '12 + x.n')}, s.kept)")
    return _let({"n": _int("s.at", 4), "kind": _text("s.at + 4", 4)}, f"CASE WHEN x.n IS NULL OR s.at + 11 + x.n > length(c) THEN {_state(phase=repr('truncated PNG'))} ELSE {new} END")


def _jpeg_kept(start: str) -> str:
    """SQL: whether the segment of marker x.m whose body begins at ``start`` stays."""
    head = _text(start, 12)
    return f"CASE WHEN x.m = 224 THEN {head} LIKE 'JFIF\\0%' OR {head} LIKE 'JFXX\\0%' WHEN x.m = 226 THEN {head} LIKE 'ICC\\_PROFILE\\0%' WHEN x.m = 238 THEN {head} LIKE 'Adobe%' ELSE NOT (x.m BETWEEN 224 AND 239 OR x.m = 254) END".replace("\\0", "\0")


def _jpeg() -> str:
    bad, cut = (_state(phase=repr(x)) for x in ("damaged JPEG", "truncated JPEG"))
    exif = f"IF(x.m = 225 AND s.exif IS NULL AND {_text('x.at + 4', 6)} = 'Exif\0\0', substring(c, cast(x.at + 10 as int), cast(x.n - 8 as int)), s.exif)"
    first = f"IF(s.insert IS NULL AND NOT (x.m = 224 AND {_jpeg_kept('x.at + 4')}), x.at, s.insert)"
    # The place of the insertion must be known before the range of the segment there is joined to others.
    kept = _keep("x.at", "2 + x.n").replace("s.insert", first)
    head = f"""CASE WHEN s.at + 3 > length(c) OR x.mark <> 255 THEN {bad} WHEN x.m = 255 THEN {_state("s.at + 1")} WHEN x.n < 2 OR s.at + 1 + x.n > length(c) THEN {bad}
        ELSE {_state("s.at + 2 + x.n", "IF(x.m = 218, 'scan', 'go')", first, exif, f"IF({_jpeg_kept('x.at + 4')}, {kept}, s.kept)")} END"""
    segment = {"at": "s.at", "mark": _int("s.at", 1), "m": _int("s.at + 1", 1), "n": _int("s.at + 2", 2)}
    # Coded data go on to the next marker but fill bytes, stuffed ones and restarts.
    find = r"regexp_instr(decode(substring(c, cast(s.at as int)), 'ISO-8859-1'), 'ÿ[^\u0000Ð-×]')"
    at = f"IF({find} = 0, null, s.at + {find} - 1)"
    scan = f"""CASE WHEN x.at IS NULL THEN {cut} WHEN x.m = 255 THEN {_state("x.at + 1", kept=_keep("s.at", "x.at - s.at"))}
        WHEN x.m = 217 THEN {_state("x.at + 2", "'done'", kept=_keep("s.at", "x.at + 2 - s.at"))}
        WHEN x.n IS NULL OR x.n < 2 OR x.at + 1 + x.n > length(c) THEN {cut}
        WHEN {_jpeg_kept("x.at + 4")} THEN {_state("x.at + 2 + x.n", kept=_keep("s.at", "x.at + 2 + x.n - s.at"))}
        ELSE {_state("x.at + 2 + x.n", kept=_keep("s.at", "x.at - s.at"))} END"""
    marker = f"transform(array({at}), y -> {_let({'at': 'y', 'm': _int('y + 1', 1), 'n': _int('y + 2', 2)}, scan)})[0]"
    return f"CASE WHEN s.phase = 'scan' THEN {marker} ELSE {_let(segment, head)} END"


def _webp() -> str:
    names = ", ".join(map(repr, WEBP_KEEP))
    whole = "8 + x.n + x.n % 2"
    # The byte of flags is put in anew.
    flags = f"concat(s.kept, array(named_struct('at', s.at, 'size', 8L), named_struct('at', s.at + 9, 'size', {whole} - 9)))"
    kept = f"CASE WHEN x.kind = 'VP8X' AND x.n > 0 AND s.insert IS NULL THEN {flags} WHEN x.kind IN ({names}) THEN {_keep('s.at', whole)} ELSE s.kept END"
    new = _state(f"s.at + {whole}", "'go'", "IF(x.kind = 'VP8X' AND x.n > 0 AND s.insert IS NULL, s.at + 9, s.insert)", "IF(x.kind = 'EXIF' AND s.exif IS NULL, substring(c, cast(s.at + 8 as int), cast(x.n as int)), s.exif)", kept)
    return _let({"n": _int("s.at + 4", 4, True), "kind": _text("s.at", 4)}, f"CASE WHEN s.at + 7 > length(c) THEN {_state(phase=repr('done'))} WHEN s.at + 7 + x.n > length(c) THEN {_state(phase=repr('truncated WebP'))} ELSE {new} END")


_FORMAT = "CASE WHEN startswith(c, X'FFD8FF') THEN 'jpeg' WHEN startswith(c, X'89504E470D0A1A0A') THEN 'png' WHEN startswith(c, X'52494646') AND substring(c, 9, 4) = X'57454250' THEN 'webp' END"


def _orientation() -> str:
    """SQL: from the walk's Exif block w.exif, the scalar orientation 2 to 8 of its first directory; null if there is none or it is 1."""
    num = lambda start, n: f"IF(substring(c, 1, 2) = X'4949', {_int(start, n, True)}, {_int(start, n)})"
    fields = f"transform(sequence(0, cast(x.n as int) - 1), i -> named_struct('tag', {num('x.at + 3 + 12 * i', 2)}, 'kind', {num('x.at + 5 + 12 * i', 2)}, 'count', {num('x.at + 7 + 12 * i', 4)}, 'value', {num('x.at + 11 + 12 * i', 2)}))"
    found = f"filter({fields}, f -> f.tag = 274 AND f.kind = 3 AND f.count = 1 AND f.value BETWEEN 2 AND 8)"
    inner = _let({"at": num("5", 4), "n": num(f"{num('5', 4)} + 1", 2)}, f"IF(x.n BETWEEN 1 AND 4096, get({found}, 0).value, null)")
    return f"transform(array(w.exif), c -> IF(substring(c, 1, 4) IN (X'49492A00', X'4D4D002A'), {inner}, null))[0]"


def walked(files: DataFrame, content: str, name: str) -> DataFrame:
    """Adds ``name``: struct<format, phase (done, or why not), insert, exif, kept (ranges from 1), orientation> of a walk over ``content``."""
    begin = {"jpeg": ("3", "array(named_struct('at', 1L, 'size', 2L))"), "png": ("9", "array(named_struct('at', 1L, 'size', 8L))"), "webp": ("13", "cast(array() as array<struct<at: bigint, size: bigint>>)")}
    steps = {"jpeg": _jpeg(), "png": _png(), "webp": _webp()}
    least = {"jpeg": 2, "png": 12, "webp": 8}
    state = "CASE f " + " ".join(
        f"WHEN '{f}' THEN aggregate(sequence(1, cast(least({STEPS}, length(c) div {least[f]} + 1) as int)), {_state(at, repr('go'), 'null', 'cast(null as binary)', kept)}, (s, i) -> CASE WHEN s.phase NOT IN ('go', 'scan') THEN s ELSE {steps[f]} END)" for f, (at, kept) in begin.items()
    ) + " END"
    walk = F.expr(f"transform(array({content}), c -> transform(array(IF(length(c) <= {BYTES}, {_FORMAT}, null)), f -> named_struct('format', f, 'state', {state}))[0])[0]")
    rows = files.withColumn("__walk", walk).withColumn("__w", F.col("__walk.state"))
    turned = F.expr(_orientation().replace("w.exif", "__w.exif"))
    phase = F.when(F.col("__walk.format").isNull(), "unsupported").when(F.col("__w.phase").isin("go", "scan"), "too many chunks").otherwise(F.col("__w.phase"))
    made = F.struct(F.col("__walk.format").alias("format"), phase.alias("phase"), F.col("__w.insert").alias("insert"), F.col("__w.exif").alias("exif"), F.col("__w.kept").alias("kept"), turned.alias("orientation"))
    return rows.withColumn(name, made).drop("__walk", "__w")


def _cut(content: str, ranges: str) -> str:
    return f"aggregate({ranges}, X'', (a, r) -> concat(a, substring({content}, cast(r.at as int), cast(r.size as int))))"


def _be(value: str, n: int) -> str:
    return f"unhex(lpad(hex(cast({value} as bigint)), {2 * n}, '0'))"


def sanitised(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds clean (binary; null if refused), refused (why, else null) and verified of JPEG, PNG and WebP contents.

    JPEG keeps what is no APPn segment or comment, and JFIF, colour profiles and Adobe's marker; what follows the image goes.
    PNG and WebP keep the chunks of PNG_KEEP and WEBP_KEEP. Null, other, damaged and too large contents are refused. ``verified``
    is the second walk's finding: the copy holds the same ranges, the orientation block alone beside them, and turns the picture alike.
    """
    rows = walked(files, content, "__from")
    w = "__from"
    block = f"concat(X'{BEFORE}', {_be(f'{w}.orientation', 2)}, X'{AFTER}')"
    turn = lambda made: f"IF({w}.orientation IS NULL, X'', {made})"
    jpeg = turn(f"concat(X'FFE1', X'0022', X'457869660000', {block})")
    png = turn(f"concat(X'0000001A', X'65584966', {block}, {_be(f'crc32(concat(X{chr(39)}65584966{chr(39)}, {block}))', 4)})")
    flags = f"IF({w}.insert IS NULL, X'', {_be(f'(cast(conv(hex(substring({content}, cast({w}.insert - 1 as int), 1)), 16, 10) as int) & 243) | IF({w}.orientation IS NULL, 0, 8)', 1)})"
    put = f"CASE {w}.format WHEN 'jpeg' THEN {jpeg} WHEN 'png' THEN {png} ELSE {flags} END"
    before, after = (_cut(content, f"filter({w}.kept, r -> {c})") for c in (f"r.at < coalesce({w}.insert, 9223372036854775807)", f"r.at >= {w}.insert"))
    body = f"concat({before}, {put}, coalesce({after}, X''))"
    # A last chunk of odd size whose padding is missing is padded; the size in the head is that of what is left.
    tail = f"IF({w}.insert IS NULL OR {w}.orientation IS NULL, X'', concat(X'45584946', X'1A000000', {block}))"
    padded = f"transform(array({body}), b -> concat(b, IF(length(b) % 2 = 1, X'00', X''), {tail}))[0]"
    riff = f"transform(array({padded}), b -> concat(X'52494646', unhex(reverse_hex), X'57454250', b))[0]"
    size = "lpad(hex(length(b) + 4), 8, '0')"
    riff = riff.replace("reverse_hex", f"concat(substring({size}, 7, 2), substring({size}, 5, 2), substring({size}, 3, 2), substring({size}, 1, 2))")
    clean = F.when(F.col(f"{w}.phase") == "done", F.expr(f"IF({w}.format = 'webp', {riff}, {body})"))
    rows = rows.withColumn("clean", clean).withColumn("refused", F.when(F.col(f"{w}.phase") != "done", F.col(f"{w}.phase")))
    rows = walked(rows, "clean", "__to")
    # Padding that is missing at the end counts as given.
    payload = lambda c, x: F.expr(f"transform(array({_cut(c, f'{x}.kept')}), p -> sha2(concat(p, IF(length(p) < aggregate({x}.kept, 0L, (a, r) -> a + r.size), X'00', X'')), 256))[0]")
    kept = F.aggregate("__to.kept", F.lit(0).cast("long"), lambda a, r: a + r["size"])
    extra = F.when(F.col("__to.orientation").isNull(), 0).otherwise(F.when(F.col("__to.format") == "jpeg", 36).when(F.col("__to.format") == "png", 38).otherwise(34))
    frame = F.when(F.col("__to.format") == "webp", 12 + F.col("__to.insert").isNotNull().cast("int")).otherwise(0)
    same = (F.col("__to.phase") == "done") & (F.col("__to.format") == F.col(f"{w}.format")) & F.col("__to.orientation").eqNullSafe(F.col(f"{w}.orientation")) & (payload(content, w) == payload("clean", "__to"))
    minimal = F.col("__to.orientation").isNull() | (F.col("__to.exif") == F.expr(block.replace(f"{w}.", "__to.")))
    return rows.withColumn("verified", F.when(F.col("clean").isNotNull(), same & minimal & (kept + extra + frame == F.length("clean")))).drop("__from", "__to")
