"""Kinds of files by name, and types by content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .paths import _c

#: Extensions of each kind.
KINDS = {
    "photo": "jpg jpeg jpe jfif png webp heic heif avif bmp tif tiff svg ico dng cr2 cr3 nef arw orf rw2 raf raw".split(),
    "gif": ["gif"],
    "video": "mp4 mov mkv webm avi m4v wmv flv mpg mpeg 3gp mts m2ts ts ogv".split(),
    "audio": "mp3 wav flac aac m4a ogg oga opus aiff aif wma alac".split(),
    "document": "pdf txt md markdown rtf doc docx odt xls xlsx ods csv tsv ppt pptx odp pages numbers key epub json xml html htm log yaml yml".split(),
}
#: What screenshots' and screen recordings' names begin with.
SCREENSHOTS = ["screenshot", "screen shot", "captura de pantalla", "captura de tela", "capture d’écran", "capture d'écran", "bildschirmfoto", "schermata", "schermafbeelding", "skärmavbild", "zrzut ekranu", "снимок экрана", "スクリーンショット", "屏幕截图", "截屏", "螢幕截圖", "스크린샷"]
RECORDINGS = ["screen recording", "screenrecording", "screen_recording", "screenrecorder", "grabación de pantalla", "gravação de tela", "enregistrement de l’écran", "enregistrement de l'écran", "bildschirmaufnahme", "registrazione schermo", "schermopname", "skärminspelning", "nagranie ekranu", "запись экрана", "画面収録", "屏幕录制", "螢幕錄影", "화면 기록"]
#: The family of each type.
FAMILIES = {
    "image": "jpeg png gif webp bmp cr2 tiff orf rw2 raf ico psd heif avif cr3".split(),
    "video": "avi mov 3gp m4v mp4 webm mkv flv asf mpeg mpegts ogv".split(),
    "audio": "wav m4a flac mp3 opus ogg aiff midi amr aac".split(),
    "executable": "macho javaclass elf pe dex wasm lnk jar xar".split(),
    "script": "scpt shebang".split(),
    "document": "pdf rtf ole epub odf ooxml".split(),
    "archive": "zip gzip bzip2 xz zstd 7z rar cab tar cpio".split(),
    "data": "sqlite bplist plist empty".split(),
    "font": "font woff".split(),
    "web": "html svg".split(),
    "text": "xml text".split(),
    "unknown": ["unknown"],
}
#: Content signatures in the order in which they are tried: a type, and the bytes that stand at places from the beginning.
#: A rule's name in the bytes' stead is one of ``_rules``.
SIGNATURES = [
    ("jpeg", {0: b"\xff\xd8\xff"}),
    ("png", {0: b"\x89PNG\r\n\x1a\n"}),
    ("gif", {0: b"GIF87a"}),
    ("gif", {0: b"GIF89a"}),
    ("webp", {0: b"RIFF", 8: b"WEBP"}),
    ("wav", {0: b"RIFF", 8: b"WAVE"}),
    ("avi", {0: b"RIFF", 8: b"AVI "}),
    ("bmp", "bmp"),
    ("cr2", {0: b"II*\0", 8: b"CR"}),
    ("cr2", {0: b"MM\0*", 8: b"CR"}),
    ("tiff", {0: b"II*\0"}),
    ("tiff", {0: b"MM\0*"}),
    ("orf", {0: b"IIRO"}),
    ("orf", {0: b"IIRS"}),
    ("rw2", {0: b"IIU\0"}),
    ("raf", {0: b"FUJIFILMCCD-RAW"}),
    ("ico", "ico"),
    ("psd", {0: b"8BPS"}),
    ("heif", {4: b"ftypheic"}),
    ("heif", {4: b"ftypheix"}),
    ("heif", {4: b"ftypheim"}),
    ("heif", {4: b"ftypheis"}),
    ("heif", {4: b"ftypmif1"}),
    ("heif", {4: b"ftypmsf1"}),
    ("heif", {4: b"ftyphevc"}),
    ("heif", {4: b"ftyphevx"}),
    ("avif", {4: b"ftypavif"}),
    ("avif", {4: b"ftypavis"}),
    ("cr3", {4: b"ftypcrx "}),
    ("mov", {4: b"ftypqt  "}),
    ("m4a", {4: b"ftypM4A "}),
    ("m4a", {4: b"ftypM4B "}),
    ("m4a", {4: b"ftypM4P "}),
    ("3gp", {4: b"ftyp3gp4"}),
    ("3gp", {4: b"ftyp3gp5"}),
    ("3gp", {4: b"ftyp3gp6"}),
    ("3gp", {4: b"ftyp3g2a"}),
    ("3gp", {4: b"ftyp3ge6"}),
    ("3gp", {4: b"ftyp3gs7"}),
    ("m4v", {4: b"ftypM4V "}),
    ("m4v", {4: b"ftypM4VH"}),
    ("m4v", {4: b"ftypM4VP"}),
    ("mp4", "other-brand"),
    ("mov", {4: b"moov"}),
    ("mov", {4: b"mdat"}),
    ("mov", {4: b"wide"}),
    ("mov", {4: b"free"}),
    ("mov", {4: b"skip"}),
    ("mov", {4: b"pnot"}),
    ("webm", "webm"),
    ("mkv", {0: b"\x1a\x45\xdf\xa3"}),
    ("flv", {0: b"FLV\x01"}),
    ("asf", {0: b"\x30\x26\xb2\x75\x8e\x66\xcf\x11"}),
    ("mpeg", {0: b"\0\0\x01\xba"}),
    ("mpegts", {0: b"G", 188: b"G", 376: b"G"}),
    ("flac", {0: b"fLaC"}),
    ("mp3", {0: b"ID3"}),
    ("ogv", "theora"),
    ("opus", "opus"),
    ("ogg", {0: b"OggS"}),
    ("aiff", {0: b"FORM", 8: b"AIFF"}),
    ("aiff", {0: b"FORM", 8: b"AIFC"}),
    ("midi", {0: b"MThd"}),
    ("amr", {0: b"#!AMR"}),
    ("aac", "adts"),
    ("mp3", "mpeg-frame"),
    ("macho", {0: b"\xfe\xed\xfa\xce"}),
    ("macho", {0: b"\xfe\xed\xfa\xcf"}),
    ("macho", {0: b"\xce\xfa\xed\xfe"}),
    ("macho", {0: b"\xcf\xfa\xed\xfe"}),
    ("macho", "universal"),
    ("javaclass", "class"),
    ("elf", {0: b"\x7fELF"}),
    ("pe", {0: b"MZ"}),
    ("dex", {0: b"dex\n"}),
    ("wasm", {0: b"\0asm"}),
    ("lnk", {0: b"L\0\0\0\x01\x14\x02\0"}),
    ("scpt", {0: b"FasdUAS"}),
    ("shebang", {0: b"#!"}),
    ("pdf", {0: b"%PDF-"}),
    ("rtf", {0: b"{\\rtf"}),
    ("ole", {0: b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"}),
    ("epub", "epub"),
    ("odf", "odf"),
    ("ooxml", "ooxml"),
    ("jar", "jar"),
    ("zip", {0: b"PK\x03\x04"}),
    ("zip", {0: b"PK\x05\x06"}),
    ("zip", {0: b"PK\x07\x08"}),
    ("gzip", {0: b"\x1f\x8b"}),
    ("bzip2", {0: b"BZh"}),
    ("xz", {0: b"\xfd7zXZ\0"}),
    ("zstd", {0: b"\x28\xb5\x2f\xfd"}),
    ("7z", {0: b"7z\xbc\xaf\x27\x1c"}),
    ("rar", {0: b"Rar!\x1a\x07"}),
    ("xar", {0: b"xar!"}),
    ("cab", {0: b"MSCF"}),
    ("tar", {257: b"ustar"}),
    ("cpio", {0: b"070707"}),
    ("cpio", {0: b"070701"}),
    ("cpio", {0: b"070702"}),
    ("sqlite", {0: b"SQLite format 3\0"}),
    ("bplist", {0: b"bplist00"}),
    ("font", {0: b"\0\x01\0\0\0"}),
    ("font", {0: b"OTTO"}),
    ("font", {0: b"true"}),
    ("font", {0: b"ttcf"}),
    ("woff", {0: b"wOFF"}),
    ("woff", {0: b"wOF2"}),
    ("html", "html"),
    ("svg", "svg"),
    ("plist", "plist"),
    ("xml", "xml"),
    ("text", "text"),
]
#: Bytes of a file's beginning that may decide its type, and of them those that must be text for it to be one.
HEAD, TEXT_HEAD = 262_144, 4096
#: The narrow sniff's brands of MP4, and extensions of text.
MP4_BRANDS = ["isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "avc1", "M4V ", "M4VH", "M4VP", "dash", "mmp4", "MSNV"]
TEXT_EXT = "txt md markdown csv tsv log json srt vtt ini yaml yml".split()
#: What the narrow sniff should find for an extension; texts' should be text.
CLAIMS = {"jpg jpeg jpe jfif": "jpeg", "png": "png", "webp": "webp", "gif": "gif", "heic heif": "heif", "mp4 m4v mov": "mp4 mov", "webm": "webm", "pdf": "pdf"}
#: Extensions of passive formats that may be opened outside.
OPEN_ALLOW = (
    "jpg jpeg png webp gif heic heif avif bmp tif tiff dng cr2 cr3 nef arw orf rw2 raf mp4 mov m4v mkv webm avi wmv mpg mpeg 3gp mts m2ts "
    "mp3 wav flac aac m4a ogg opus aiff aif pdf txt md csv tsv rtf doc docx xls xlsx ppt pptx odt ods odp pages numbers key epub srt vtt"
).split()
#: Types that the extensions may hold, where content can tell.
EXPECTED = {
    "jpg jpeg jpe jfif": "jpeg", "png": "png", "gif": "gif", "webp": "webp", "bmp": "bmp", "tif tiff dng nef arw pef srw nrw": "tiff", "cr2": "cr2 tiff", "cr3": "cr3", "orf": "orf", "rw2": "rw2", "raf": "raf", "ico": "ico", "psd": "psd",
    "heic heif hif": "heif", "avif": "avif", "svg": "svg xml", "mp4": "mp4 m4v mov 3gp", "m4v": "m4v mp4 mov", "mov qt": "mov mp4", "3gp 3g2": "3gp mp4", "webm": "webm mkv", "mkv": "mkv webm", "avi": "avi", "flv": "flv", "wmv asf wma": "asf",
    "mpg mpeg": "mpeg mpegts", "ts mts m2ts": "mpegts text", "ogv": "ogv", "mp3": "mp3", "m4a m4b aac": "m4a mp4 aac", "wav": "wav", "flac": "flac", "ogg oga": "ogg opus", "opus": "opus", "aif aiff aifc": "aiff", "mid midi": "midi", "amr": "amr",
    "pdf": "pdf", "rtf": "rtf", "doc xls ppt msg": "ole", "docx xlsx pptx": "ooxml zip", "odt ods odp": "odf zip", "epub": "epub zip", "zip": "zip", "gz tgz": "gzip", "bz2": "bzip2", "xz": "xz", "zst": "zstd", "7z": "7z", "rar": "rar", "tar": "tar",
    "pkg xar": "xar", "jar apk": "jar zip", "exe dll scr sys com": "pe", "dylib bundle so o": "macho elf", "class": "javaclass", "wasm": "wasm", "lnk": "lnk", "scpt": "scpt", "sqlite db sqlite3": "sqlite", "plist": "bplist plist",
    "ttf otf ttc": "font", "woff woff2": "woff", "html htm xhtml": "html xml text", "xml": "xml plist svg text", "txt md markdown csv tsv log json yaml yml ini srt vtt css toml": "text empty",
    "sh bash zsh command py rb pl js mjs ts.js ps1 bat cmd vbs applescript php": "shebang text",
}
FAMILY_OF_KIND = {"photo": "image", "gif": "image", "video": "video", "audio": "audio", "document": "document"}


def kind_of_ext(ext: Column | str) -> Column:
    return reduce(lambda rest, k: F.when(_c(ext).isin(KINDS[k]), k).otherwise(rest), KINDS, F.lit("other"))


def claimed_family(ext: Column | str) -> Column:
    k = kind_of_ext(ext)
    return F.element_at(F.create_map(*[F.lit(x) for p in FAMILY_OF_KIND.items() for x in p], F.lit("other"), F.lit(None).cast("string")), k)


def capture_of(name: Column | str, kind: Column | str) -> Column:
    """1: a screenshot, 2: a screen recording, 0: neither, by the beginning of the name."""
    starts = lambda words: F.lower(_c(name)).rlike("^(" + "|".join(words) + ")")
    k = _c(kind)
    return F.when((k == "photo") & starts([*SCREENSHOTS, "scr_"]), 1).when((k == "video") & starts(RECORDINGS + SCREENSHOTS), 2).otherwise(0)


def _at(c: Column, places: dict[int, bytes]) -> Column:
    """Whether ``c`` (binary) has these bytes at these places."""
    return reduce(lambda a, b: a & b, [F.startswith(c, F.lit(v)) if k == 0 else F.substring(c, k + 1, len(v)) == F.lit(v) for k, v in places.items()])


def _byte(c: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(c, at + 1, 1)), 16, 10).cast("int")


def _within(c: Column, most: int, needle: bytes) -> Column:
    return F.contains(F.substring(c, 1, most), F.lit(needle))


def open_end(c: Column) -> Column:
    """How many bytes at the end of ``c`` begin a UTF-8 character without ending it."""
    tail = F.hex(F.substring(c, -3, 3))
    three = "F0[9AB][0-9A-F][89AB][0-9A-F]|F[123][89AB][0-9A-F][89AB][0-9A-F]|F48[0-9A-F][89AB][0-9A-F]"
    two = "E0[AB][0-9A-F]|E[1-9ABCEF][89AB][0-9A-F]|ED[89][0-9A-F]|F0[9AB][0-9A-F]|F[123][89AB][0-9A-F]|F48[0-9A-F]"
    return F.when(tail.rlike(f"^(?:..)*?(?:{three})$"), 3).when(tail.rlike(f"^(?:..)*?(?:{two})$"), 2).when(tail.rlike("^(?:..)*?(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F]|F[0-4])$"), 1).otherwise(0)


def looks_like_text(content: Column | str) -> Column:
    """UTF-8, a character cut off at the end aside, without control characters but tab, line ends and form feed; a byte order mark does not count."""
    c = _c(content)
    c = F.when(F.startswith(c, F.lit(b"\xef\xbb\xbf")), F.substring(c, F.lit(4), F.octet_length(c))).otherwise(c)
    whole = F.substring(c, F.lit(1), F.octet_length(c) - open_end(c)).cast("string")
    return F.is_valid_utf8(whole) & ~whole.rlike(r"[\x00-\x08\x0b\x0e-\x1f]")


def _rules(c: Column) -> dict[str, Column]:
    """What no bytes at fixed places can say."""
    second, ogg, webm = _byte(c, 1), _at(c, {0: b"OggS"}), _at(c, {0: b"\x1a\x45\xdf\xa3"})
    zipped = _at(c, {0: b"PK\x03\x04"}) | _at(c, {0: b"PK\x05\x06"}) | _at(c, {0: b"PK\x07\x08"})
    name = F.substring(c, F.lit(31), F.coalesce(_byte(c, 26) + 256 * _byte(c, 27), F.lit(0)))
    count = F.conv(F.hex(F.substring(c, 5, 4)), 16, 10).cast("long")
    fat = _at(c, {0: b"\xca\xfe\xba\xbe"}) & (F.octet_length(c) >= 8)
    bare = F.when(F.startswith(c, F.lit(b"\xef\xbb\xbf")), F.substring(c, 4, TEXT_HEAD)).otherwise(F.substring(c, 1, TEXT_HEAD))
    # One character for each byte, so that a broken end does no harm; only ASCII is looked for.
    t = F.regexp_replace(F.decode(bare, "ISO-8859-1"), r"^[ \t\n\x0c\r]+", "")
    starts = lambda word: F.startswith(F.lower(F.left(t, F.lit(len(word)))), F.lit(word))
    inside = lambda most, word: F.contains(F.left(t, F.lit(most)), F.lit(word))
    return {
        "bmp": _at(c, {0: b"BM", 6: b"\0\0\0\0"}) & (F.octet_length(c) >= 26),
        "ico": _at(c, {0: b"\0\0\x01\0"}) & (F.octet_length(c) > 6) & (_byte(c, 4) > 0),
        "other-brand": _at(c, {4: b"ftyp"}) & (F.octet_length(c) >= 12),
        "webm": webm & _within(c, 64, b"webm"),
        "theora": ogg & _within(c, 128, b"\x80theora"),
        "opus": ogg & _within(c, 128, b"OpusHead"),
        "adts": _at(c, {0: b"\xff"}) & (second.bitwiseAND(0xF6) == 0xF0),
        "mpeg-frame": _at(c, {0: b"\xff"}) & (second.bitwiseAND(0xE0) == 0xE0) & (second.bitwiseAND(0x06) != 0),
        "universal": fat & count.between(1, 19),
        "class": fat,
        "epub": zipped & (name == F.lit(b"mimetype")) & _within(c, 200, b"application/epub+zip"),
        "odf": zipped & (name == F.lit(b"mimetype")),
        "ooxml": zipped & F.contains(c, F.lit(b"[Content_Types].xml")),
        "jar": zipped & (F.startswith(name, F.lit(b"META-INF/")) | _within(c, 512, b"AndroidManifest.xml")),
        "html": starts("<!doctype html") | starts("<html") | starts("<head") | starts("<script"),
        "svg": starts("<svg") | (starts("<?xml") & inside(1024, "<svg")),
        "plist": starts("<?xml") & (inside(512, "<plist") | inside(512, "PropertyList")),
        "xml": starts("<?xml"),
        "text": looks_like_text(F.substring(c, 1, TEXT_HEAD)),
    }


def type_of(content: Column | str, size: Column | str | None = None) -> Column:
    """The type that the first HEAD bytes of ``content`` (binary) tell; the first signature that fits wins. ``size``: of the whole file, if content is a part."""
    c = F.substring(_c(content), 1, HEAD)
    rules = _rules(c)
    n = F.coalesce(_c(size) if size is not None else F.octet_length(c), F.lit(0))
    out = F.when((n == 0) | (F.coalesce(F.octet_length(c), F.lit(0)) == 0), "empty")
    for kind, rule in SIGNATURES:
        out = out.when(rules[rule] if isinstance(rule, str) else _at(c, rule), kind)
    return out.otherwise("unknown")


def sniff(content: Column | str, ext: Column | str) -> Column:
    """The narrow classes that decide about decoding: jpeg, png, gif, webp, heif, mov, mp4, webm, pdf, executable, text, unknown."""
    c, e = F.substring(_c(content), 1, TEXT_HEAD), _c(ext)
    brand, any_of = F.substring(c, 9, 4), lambda places: reduce(lambda a, b: a | b, [_at(c, p) for p in places])
    is_in = lambda names: brand.isin(*[n.encode() for n in names])
    programs = [b"MZ", b"\x7fELF", b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe", b"\xca\xfe\xba\xbe", b"#!"]
    return (
        F.when(_at(c, {0: b"\xff\xd8\xff"}), "jpeg").when(_at(c, {0: b"\x89PNG\r\n\x1a\n"}), "png").when(any_of([{0: b"GIF87a"}, {0: b"GIF89a"}]), "gif").when(_at(c, {0: b"RIFF", 8: b"WEBP"}), "webp")
        .when(_at(c, {4: b"ftyp"}) & (F.octet_length(c) >= 12), F.when(is_in(["qt  "]), "mov").when(is_in(["heic", "heix", "heim", "heis", "mif1", "msf1"]), "heif").when(is_in(MP4_BRANDS), "mp4").otherwise("unknown"))
        .when((e == "mov") & any_of([{4: b"moov"}, {4: b"mdat"}, {4: b"wide"}, {4: b"free"}, {4: b"skip"}]), "mov")
        .when(_at(c, {0: b"\x1a\x45\xdf\xa3"}), F.when(_within(c, 64, b"webm"), "webm").otherwise("unknown"))
        .when(_at(c, {0: b"%PDF-"}), "pdf").when(any_of([{0: p} for p in programs]), "executable").when(e.isin(TEXT_EXT) & looks_like_text(c), "text").otherwise("unknown")
    )


def claimed_classes(ext: Column | str) -> Column:
    """The narrow classes that an extension claims; null where it claims none."""
    one = {e: ids.split() for exts, ids in CLAIMS.items() for e in exts.split()} | {e: ["text"] for e in TEXT_EXT}
    return F.try_element_at(F.create_map(*[x for e, ids in one.items() for x in (F.lit(e), F.array(*map(F.lit, ids)))]), _c(ext))


def may_open(ext: Column | str, sniffed: Column | str) -> Column:
    """Whether a file may be opened outside: a passive format by its extension, and no program by its content."""
    return _c(ext).isin(OPEN_ALLOW) & (_c(sniffed) != "executable")


def family_of(kind: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for f, ids in FAMILIES.items() for k in ids for x in (k, f)]), _c(kind))


def expected_types(ext: Column | str) -> Column:
    """The types that an extension may hold; null where it tells nothing."""
    one = {e: ids.split() for exts, ids in EXPECTED.items() for e in exts.split()}
    return F.try_element_at(F.create_map(*[x for e, ids in one.items() for x in (F.lit(e), F.array(*map(F.lit, ids)))]), _c(ext))
