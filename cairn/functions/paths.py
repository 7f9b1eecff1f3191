"""Paths and names as column expressions. Paths are relative to their root, with ``/`` between segments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters that turn the direction of text, as a class body.
BIDI = "‎‏؜‪-‮⁦-⁩"
#: Folders that are opaque packages, by extension; system folders; junk files.
PACKAGES = "app photoslibrary photolibrary migratedphotolibrary aplibrary imovielibrary fcpbundle theater musiclibrary tvlibrary lrdata bundle framework plugin xcodeproj xcworkspace pkg mpkg".split()
SYSTEM_DIRS = ["$recycle.bin", "system volume information", "$windows.~bt", "found.000"]
JUNK = ["thumbs.db", "desktop.ini", "ehthumbs.db"]
MAX_PATH_BYTES = 4096


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parent_of(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), "^(.*)/[^/]*$", 1)


def name_of(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def ext_of(name: Column | str) -> Column:
    """What follows the last dot, lower case; a dot in first place does not count."""
    return F.lower(F.regexp_extract(_c(name), r"^.+\.([^.]*)$", 1))


def stem_of(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"(?<=.)\.[^.]*$", "")


def ancestors(path: Column | str, itself: bool = False) -> Column:
    """All strict ancestors from the top one down, and the path itself last if asked for."""
    seg = F.split(_c(path), "/")
    n = F.size(seg) if itself else F.size(seg) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(seg, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def is_within(dest: Column | str, src: Column | str) -> Column:
    """Whether ``dest`` is ``src`` or lies below it."""
    return (_c(dest) == _c(src)) | F.startswith(_c(dest), F.concat(_c(src), F.lit("/")))


def location(path: Column | str, base: str) -> Column:
    """The parent relative to ``base``."""
    parent = parent_of(path)
    return parent if not base else F.when(parent == base, "").otherwise(F.substring(parent, F.lit(len(base) + 2), F.length(parent)))


def normal(path: Column | str) -> Column:
    """With single forward slashes and none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(path), r"\\", "/"), "/+", "/"), "^/|/$", "")


def listable(path: Column | str) -> Column:
    """Whether no segment is hidden, a package, a system folder or (at the end) junk, and the path is not too long."""
    p = F.lower(_c(path))
    folders, name = F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1), name_of(p)
    bad_dir = lambda s: s.isin(SYSTEM_DIRS) | s.rlike(rf"\.({'|'.join(PACKAGES)})$")
    return ~p.rlike(r"(^|/)\.") & ~F.exists(folders, bad_dir) & ~name.isin(JUNK) & (F.octet_length(p) <= MAX_PATH_BYTES)


def link_escapes(link_path: Column | str, target: Column | str) -> Column:
    """Whether a link at ``link_path`` (below the root) points outside the root, by its text alone."""
    full = F.when(F.startswith(_c(target), F.lit("/")), F.lit("..")).otherwise(F.concat_ws("/", F.nullif(parent_of(link_path), F.lit("")), _c(target)))
    step = lambda depth, s: F.when(depth < 0, depth).when(s == "..", depth - 1).when(s.isin("", "."), depth).otherwise(depth + 1)
    return F.aggregate(F.split(full, "/"), F.lit(0), step) < 0


def display_safe(s: Column | str) -> Column:
    """Control and text-direction characters become U+FFFD."""
    return F.regexp_replace(_c(s), rf"[\p{{Cc}}{BIDI}]", "�")


def path_flags(path: Column | str) -> Column:
    """What is odd about an archive entry's path: absolute, drive-letter, traversal, control-chars."""
    p = _c(path)
    flags = [("absolute", p.rlike(r"^[/\\]")), ("drive-letter", p.rlike("^[A-Za-z]:")), ("traversal", p.rlike(r"(^|[/\\])\.\.([/\\]|$)")), ("control-chars", p.rlike(rf"[\p{{Cc}}{BIDI}]"))]
    return F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in flags]))


def name_problem(name: Column | str) -> Column:
    """The first rule that a new name breaks: empty, dots, long, hidden, characters, ending, reserved; null if it is fine."""
    n = _c(name)
    stem = F.upper(F.substring_index(n, ".", 1))
    return (
        F.when(F.trim(n) == "", "empty").when(n.isin(".", ".."), "dots").when(F.octet_length(n) > 255, "long").when(F.startswith(n, F.lit(".")), "hidden")
        .when(n.rlike(rf'[/\\:\x00<>"|?*\p{{Cc}}{BIDI}]'), "characters").when(n.rlike(r"[ .]$"), "ending").when(stem.rlike("^(CON|PRN|AUX|NUL|(COM|LPT)[0-9])$"), "reserved")
    )


def numbered(name: Column | str, n: Column) -> Column:
    """``photo.jpg`` as ``photo 2.jpg``; a number from 2 that the stem ends in is replaced."""
    stem = F.regexp_replace(stem_of(name), r"^(.+) (0*[2-9]|0*[1-9]\d+)$", "$1")
    dot = F.regexp_extract(_c(name), r"^.+(\.[^.]*)$", 1)
    return F.concat(stem, F.lit(" "), n.cast("string"), dot)


def sanitized_names(name: Column | str, count: int) -> Column:
    """``a-sanitized.jpg``, ``a-sanitized-2.jpg`` and so on."""
    dot = F.regexp_extract(_c(name), r"^.+(\.[^.]*)$", 1)
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: F.concat(stem_of(name), F.lit("-sanitized"), F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise(""), dot))
