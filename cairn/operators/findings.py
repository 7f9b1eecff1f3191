"""Findings about names and contents, and the health of media: arrays of codes built by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import kinds, paths
from .browse import boundaries

#: Extensions that run code or install software.
EXECUTABLE = "app exe scr bat cmd com pif msi msp js jse vbs vbe wsf wsh ps1 psm1 hta cpl jar command sh bash zsh csh tool scpt applescript workflow action pkg mpkg dmg lnk url webloc inetloc terminal py rb pl dll dylib so deb rpm apk appx msix reg inf desktop xll xlam docm xlsm pptm".split()
LEVELS = {"info": 0, "attention": 1, "high": 2}
MAX_PIXELS, MAX_EDGE = 100_000_000, 30_000
TAIL = 1024


def _found(rules: list[tuple[str, str, Column]]) -> Column:
    """The rules that hold as structs, highest level first, in the rules' order within a level."""
    rows = F.array(*[F.when(on, F.struct(F.lit(-LEVELS[level]).alias("order"), F.lit(i).alias("place"), F.lit(level).alias("level"), F.lit(code).alias("code"))) for i, (code, level, on) in enumerate(rules)])
    return F.transform(F.array_sort(F.array_compact(rows)), lambda x: F.struct(x["level"].alias("level"), x["code"].alias("code")))


def name_rules(name: str = "name") -> list[tuple[str, str, Column]]:
    n = F.col(name)
    parts = F.split(F.lower(n), r"\.")
    last, before = F.trim(F.try_element_at(parts, F.lit(-1))), F.trim(F.try_element_at(parts, F.lit(-2)))
    double = (F.size(parts) >= 3) & kinds.claimed_family(before).isNotNull() & last.isin(EXECUTABLE)
    return [("bidi-control", "high", n.rlike(f"[{paths.BIDI}]")), ("double-extension", "high", F.coalesce(double, F.lit(False))), ("padded-name", "attention", F.contains(n, F.lit("    ")) | n.rlike(r"\s$"))]


def name_findings(name: str = "name") -> Column:
    return _found(name_rules(name))


#: Markers of a JPEG that are followed on the way to its size.
MARKERS = 1024


def jpeg_size(head: Column) -> Column:
    """struct<w, h> of the first frame that a JPEG's markers lead to; null if they break off. Each step skips a segment or a filler."""
    byte = lambda at: F.conv(F.hex(F.substring(head, at.cast("int"), F.lit(1))), 16, 10).cast("long")
    two = lambda at: F.when(F.length(head) > at, F.conv(F.hex(F.substring(head, at.cast("int"), F.lit(2))), 16, 10).cast("long"))
    none = F.lit(None).cast("long")
    state = lambda at, w=none, h=none: F.struct(F.lit(at).cast("long").alias("at") if isinstance(at, int) else at.cast("long").alias("at"), w.alias("w"), h.alias("h"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        marker = byte(at + 1)
        frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        over = at.isNull() | (at + 8 > F.length(head)) | (byte(at) != 0xFF)
        return F.when(over, F.when(s["w"].isNotNull(), s).otherwise(state(none))).when(marker == 0xFF, state(at + 1)).when(frame, state(none, two(at + 7), two(at + 5))).when(two(at + 2) < 2, state(none)).otherwise(state(at + 2 + two(at + 2)))

    most = F.least(F.lit(MARKERS), F.floor(F.length(head) / 2) + 1).cast("int")
    return F.when(head.isNotNull(), F.aggregate(F.sequence(F.lit(1), most), state(3), step))


def dimensions(content: Column | str, kind: Column) -> Column:
    """struct<w, h> that png, gif, bmp, webp and jpeg headers declare; null for others. A JPEG's size stands behind markers."""
    c = F.substring(F.col(content) if isinstance(content, str) else content, 1, kinds.HEAD)
    byte = lambda at: F.conv(F.hex(F.substring(c, at, 1)), 16, 10).cast("long")
    number = lambda at, n, little: sum((byte(at + i) * 256 ** (i if little else n - 1 - i) for i in range(n)), F.lit(0))
    signed = lambda at: F.abs(F.when(number(at, 4, True) >= 1 << 31, number(at, 4, True) - (1 << 32)).otherwise(number(at, 4, True)))
    pair = lambda w, h: F.when(w.isNotNull() & h.isNotNull(), F.struct(w.alias("w"), h.alias("h")))
    bits, part = number(22, 4, True), F.substring(c, 13, 4)
    webp = (
        F.when(part == F.lit(b"VP8X"), pair(number(25, 3, True) + 1, number(28, 3, True) + 1)).when(part == F.lit(b"VP8 "), pair(number(27, 2, True).bitwiseAND(0x3FFF), number(29, 2, True).bitwiseAND(0x3FFF)))
        .when(part == F.lit(b"VP8L"), pair(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1))
    )
    jpeg = jpeg_size(F.when(kind == "jpeg", c))
    return (
        F.when(kind == "png", pair(number(17, 4, False), number(21, 4, False))).when(kind == "gif", pair(number(7, 2, True), number(9, 2, True))).when(kind == "bmp", pair(signed(19), signed(23)))
        .when(kind == "webp", webp).when(kind == "jpeg", pair(jpeg["w"], jpeg["h"]))
    )


#: Facts that a caller may know of a file, as boolean columns: permission, download mark, an earlier failure to decode, a video that
#: stopped the media engine, a container that could not be read.
FACTS = ("executable_bit", "quarantined", "decode_failed", "media_blocked", "broken_container")


def assess(files: DataFrame, content: str = "content", tail: str | None = None) -> DataFrame:
    """Adds type and findings. ``content``: a file's bytes or, with ``tail`` (its last TAIL bytes), its first. A link is only judged as such; columns link, link_outside and FACTS may be absent."""
    c = F.col(content).cast("binary")
    # A generator of one row keeps the optimizer from copying a long expression to each place that uses it.
    once = lambda x: F.explode(F.array(x))
    rows = files.withColumn("type", once(kinds.type_of(c, "size"))).withColumn("_dims", dimensions(c, F.col("type")))
    family, expected = kinds.family_of("type"), kinds.expected_types("ext")
    code = family.isin("executable", "script")
    claimed = kinds.claimed_family("ext").isNotNull()
    wrong = F.coalesce(expected.isNotNull() & ~F.array_contains(expected, F.col("type")) & (F.col("type") != "empty"), F.lit(False))
    disguised = wrong & code & claimed
    w, h = F.col("_dims.w"), F.col("_dims.h")
    decoded = w * h * 3
    end = F.substring(c, -TAIL, TAIL) if tail is None else F.col(tail).cast("binary")
    without = lambda mark: (F.octet_length(end) > 0) & ~F.contains(end, F.lit(mark))
    cut = F.when(F.col("type") == "jpeg", without(b"\xff\xd9")).when(F.col("type") == "png", without(b"IEND")).when(F.col("type") == "gif", without(b"\x3b")).when(F.col("type") == "pdf", without(b"%%EOF")).otherwise(False)
    no = F.lit(False)
    fact = {k: F.coalesce(F.col(k), no) if k in files.columns else no for k in FACTS}
    rules = [
        *name_rules(), ("disguised-executable", "high", disguised), ("unknown-signature", "attention", wrong & ~disguised & (F.col("type") == "unknown")), ("extension-mismatch", "attention", wrong & ~disguised & (F.col("type") != "unknown")),
        ("unexpected-executable", "attention", expected.isNull() & code & ~F.col("ext").isin(EXECUTABLE)), ("runs-code", "info", F.col("ext").isin(EXECUTABLE) | code), ("executable-bit", "attention", fact["executable_bit"] & family.isin("image", "video", "audio", "document")),
        ("quarantine", "info", fact["quarantined"]), ("archive", "info", (family == "archive") | F.col("type").isin("jar", "xar")), ("active-content", "info", F.col("type").isin("svg", "html")), ("invalid-dimensions", "attention", F.coalesce((w == 0) | (h == 0), no)),
        ("extreme-dimensions", "attention", F.coalesce((w > 0) & (h > 0) & ((w * h > MAX_PIXELS) | (w > MAX_EDGE) | (h > MAX_EDGE)), no)), ("compression-ratio", "attention", F.coalesce((F.col("size") > 0) & (decoded / F.greatest("size", F.lit(1)) >= 1001) & (decoded > 50_000_000), no)),
        ("truncated", "attention", cut), ("broken-container", "attention", fact["broken_container"]), ("decode-failed", "attention", fact["decode_failed"]), ("media-engine-failure", "high", fact["media_blocked"]), ("empty", "info", F.col("size") == 0),
    ]
    found = _found(rules)
    if "link" in files.columns:
        linked = _found([*name_rules(), ("symlink", "info", F.col("link").isNotNull()), ("symlink-outside", "attention", F.coalesce(F.col("link_outside"), no))])
        found = F.when(F.col("link").isNotNull(), linked).otherwise(found)
    return rows.withColumn("findings", once(found)).drop("_dims")


def summary(findings: str = "findings") -> Column:
    """anomalies, match (none, and the extension may hold the type) or plain."""
    expected = kinds.expected_types("ext")
    return F.when(F.exists(findings, lambda f: f["level"] != "info"), "anomalies").when(F.coalesce(F.array_contains(expected, F.col("type")), F.lit(False)), "match").otherwise("plain")


def report(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, name, ext, size, type, family, sniffed, ext_matches, may_open, codes, summary): what is known of each file without decoding it; names are made safe to show."""
    rows = assess(files, content).withColumn("sniffed", kinds.sniff(F.col(content).cast("binary"), "ext"))
    return rows.select(
        paths.display_safe("path").alias("path"), paths.display_safe("name").alias("name"), paths.display_safe("ext").alias("ext"), "size", "type", kinds.family_of("type").alias("family"), "sniffed", F.array_contains(kinds.expected_types("ext"), F.col("type")).alias("ext_matches"),
        kinds.may_open("ext", "sniffed").alias("may_open"), F.transform("findings", lambda f: f["code"]).alias("codes"), summary().alias("summary"),
    )


def health(assessed: DataFrame, content: str | None = None, video: str | None = None) -> DataFrame:
    """(path, category, reason) of media with a problem, one each: risk, then broken, then what the kind does not hold.

    ``content``: a column of bytes, by whose narrow class images and videos that cannot be decoded are unsupported; without it the
    type's family decides. ``video``: a column of ``media.video_status`` of those that can."""
    codes = F.transform("findings", lambda f: f["code"])
    risky = F.filter("findings", lambda f: (f["level"] == "high") | (f["code"] == "extension-mismatch"))
    family = kinds.family_of("type")
    unknown = family == "unknown"
    sniffed = kinds.sniff(F.col(content).cast("binary"), "ext") if content else None
    image = sniffed.isin("jpeg", "png", "webp", "gif", "heif") if content else family == "image"
    film = sniffed.isin("mp4", "mov", "webm") if content else family == "video"
    wrong = (F.col("kind").isin("photo", "gif") & ~image) | ((F.col("kind") == "video") & ~film) | ((F.col("kind") == "audio") & ~family.isin("audio", "video"))
    broken = F.exists(codes, lambda c: c.isin("truncated", "broken-container"))
    status = F.when(F.col("kind") == "video", F.col(video)) if video else F.lit(None).cast("string")
    category = (
        F.when(F.size(risky) > 0, "risk").when((F.col("size") == 0) | broken | (unknown & wrong), "broken").when(wrong, "unsupported")
        .when(status == "unsupported-codec", "unsupported").when(status.isin("no-video", "damaged"), "broken").when(status == "blocked", "failed")
    )
    reason = (
        F.when(F.size(risky) > 0, F.get(risky, F.lit(0))["code"]).when(F.col("size") == 0, "empty").when(broken, F.get(F.filter(codes, lambda c: c.isin("truncated", "broken-container")), F.lit(0)))
        .when(unknown & wrong, "unrecognisable").when(wrong, F.col("type")).otherwise(status)
    )
    return assessed.where("kind IN ('photo', 'gif', 'video', 'audio')").select("path", category.alias("category"), reason.alias("reason")).where("category IS NOT NULL")


def health_page(found: DataFrame, catalog: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of findings, by path, with what the catalog holds of them; a page is cut first, so it is shorter where the catalog has lost a file."""
    cut = found.orderBy("path").offset(offset).limit(min(limit, 500))
    return cut.join(catalog, "path")


def preview(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds preview: the first 256 KiB of what is text by its extension and beginning, else null."""
    c = F.col(content).cast("binary")
    head = F.substring(c, 1, kinds.HEAD)
    return files.withColumn("preview", F.when(kinds.sniff(c, "ext") == "text", F.try_validate_utf8(F.substring(head, F.lit(1), F.octet_length(head) - kinds.open_end(head)).cast("string"))))


def archive_findings(entries: DataFrame) -> DataFrame:
    """Per archive: entries, sizes, ratio, deepest nesting, flags, and codes for what looks like a bomb.

    ``entries``: archive, path, size, packed, depth."""
    flags = entries.withColumn("flag", F.explode_outer(paths.path_flags("path")))
    by = entries.groupBy("archive").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.sum("packed").alias("packed"), F.max("depth").alias("depth"))
    flagged = flags.where("flag IS NOT NULL").groupBy("archive").agg(F.count("*").alias("flags"))
    ratio = F.col("bytes") / F.greatest("packed", F.lit(1))
    gib = 1 << 30
    codes = [("bomb", (F.col("bytes") > 50 * gib) | ((ratio > 1000) & (F.col("bytes") > gib))), ("high-ratio", (ratio > 100) & (F.col("bytes") > 100 << 20)), ("many-entries", F.col("entries") > 50_000), ("deep", F.col("depth") > 3)]
    return by.join(flagged, "archive", "left").select("*", F.array_compact(F.array(*[F.when(on, F.lit(k)) for k, on in codes])).alias("codes")).withColumn("flags", F.coalesce("flags", F.lit(0)))


def archive_report(entries: DataFrame) -> DataFrame:
    """(archive, entries, bytes, packed, depth, codes) of the listings of ``archives.entries``, codes by level, the highest first."""
    flags = paths.path_flags("path")
    has = lambda flag: F.coalesce(F.count_if(F.array_contains(flags, flag)), F.lit(0))
    real = F.col("path").isNotNull()
    top = F.col("depth") == 0
    by = entries.groupBy("archive").agg(
        F.count_if(real).alias("entries"), F.coalesce(F.sum(F.when(top, F.col("size"))), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(top, F.col("packed"))), F.lit(0)).alias("packed"), F.max(F.col("depth") + F.col("nested").cast("int")).alias("depth"),
        has("traversal").alias("traversal"), (has("absolute") + has("drive-letter")).alias("absolute"), F.count_if("is_link").alias("links"), F.bool_or("encrypted").alias("encrypted"), F.bool_or("partial").alias("partial"),
    )
    ratio = F.when(F.col("packed") > 0, F.col("bytes") / F.col("packed")).otherwise(0.0)
    bomb = (F.col("bytes") > 50 << 30) | ((ratio > 1000) & (F.col("bytes") > 1 << 30))
    rules = [
        ("archive-traversal", "high", F.col("traversal") > 0), ("archive-absolute", "high", F.col("absolute") > 0), ("archive-symlinks", "attention", F.col("links") > 0), ("archive-bomb", "high", bomb), ("archive-ratio", "attention", ~bomb & (ratio > 100) & (F.col("bytes") > 100 << 20)),
        ("archive-entries", "attention", F.col("entries") > 50_000), ("archive-nesting", "attention", F.col("depth") >= 2), ("archive-nested", "info", F.col("depth") == 1), ("archive-encrypted", "info", F.col("encrypted")), ("archive-partial", "info", F.col("partial")),
    ]
    return by.select("archive", "entries", "bytes", "packed", "depth", F.transform(_found(rules), lambda f: f["code"]).alias("codes"))


def visible_health(assessed: DataFrame, private: DataFrame, content: str | None = None, video: str | None = None) -> DataFrame:
    """``health`` of what can be seen from the top: files in private folders (path) are not told."""
    return health(boundaries(assessed, private.select(F.col("path").alias("folder"))).where("boundary = 0").drop("boundary"), content, video)
