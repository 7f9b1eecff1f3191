"""Sensitive fields in texts and in files' metadata, places on a grid, waveforms."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values

#: Patterns of sensitive values in text, by category.
TEXT_CLASSES = {
    "person": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "device": r"(^|[^0-9.])[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}([^0-9.]|$)",
    "identifier": r"(^|[^0-9A-Za-z])[0-9]{16}([^0-9A-Za-z]|$)",
    "comment": r"[Ll]icensed under|[Rr]eleased under",
}
#: Metadata tags, by category.
TAG_CLASSES = {
    "location": "GPSLatitude GPSLongitude GPSAltitude GPSAltitudeRef GPSTimeStamp GPSDestLatitude GPSDestLongitude Location City State Country CountryCode Sublocation ProvinceState CountryName WorldRegion".split(),
    "person": "creator Artist Author Credit AuthorsPosition Owner OwnerName CameraOwnerName CaptionWriter PersonInImage rights Copyright Contributor publisher CiEmailWork CiTelWork CiAdrCity CiAdrExtadr CiUrlWork".split(),
    "device": "Make Model Lens LensMake LensModel LensInfo LensSpecification SerialNumber LensSerialNumber CameraSerialNumber BodySerialNumber InternalSerialNumber".split(),
    "software": "CreatorTool Software softwareAgent HostComputer encoder".split(),
    "comment": "description title comment UserComment Headline Instructions ImageDescription information".split(),
    "identifier": "DocumentID InstanceID OriginalDocumentID ImageUniqueID identifier".split(),
}
MAX_FIELDS = 24


def classes_of(text: Column | str) -> Column:
    """The categories that occur in a text, sorted."""
    t = F.col(text) if isinstance(text, str) else text
    # A run without the sign is tried once, not from each of its characters.
    once = {k: p.replace("[A-Za-z0-9._%+-]+@", "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@") for k, p in TEXT_CLASSES.items()}
    return F.array_sort(F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in once.items()])))


def class_of_tag(tag: Column | str) -> Column:
    t = F.lower(F.col(tag) if isinstance(tag, str) else tag)
    one = {x.lower(): k for k, words in TAG_CLASSES.items() for x in words}
    return F.try_element_at(F.create_map(*[F.lit(x) for p in one.items() for x in p]), t)


def hits(rows: DataFrame, categories: str = "categories") -> DataFrame:
    return rows.where(F.size(categories) > 0)


def category_counts(rows: DataFrame, categories: str = "categories") -> DataFrame:
    """Each row counts once for each category it has."""
    return rows.select(F.explode(F.array_distinct(categories)).alias("category")).groupBy("category").agg(F.count("*").alias("files"))


def places(rows: DataFrame, digits: int = 5) -> DataFrame:
    return rows.where(values.valid_position("lat", "lon")).select("id", F.round("lat", digits).alias("lat"), F.round("lon", digits).alias("lon"))


def grid(points: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """(cx, cy, members, x, y): cells with their centroid."""
    by = points.groupBy(F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy"))
    return by.agg(F.count("*").alias("members"), F.avg(x).alias("x"), F.avg(y).alias("y"))


def bounds(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))


def peaks(samples: DataFrame, at: str, value: str, total: int, bins: int = 600) -> DataFrame:
    """(bin, peak): the largest absolute value of each of ``bins`` equal runs."""
    per = max(1, total // bins)
    return samples.groupBy(F.least(F.floor(F.col(at) / per), F.lit(bins - 1)).alias("bin")).agg(F.max(F.abs(value)).alias("peak"))


def capture(fields: Column | str) -> Column:
    """struct<time_ms, camera> from fields (name, value): the original time or else the time, and make with model."""
    f = F.col(fields) if isinstance(fields, str) else fields
    value = lambda name: F.get(F.filter(f, lambda x: x["name"] == name), F.lit(0))["value"]
    sub = F.coalesce(F.rpad(F.left(F.regexp_extract(value("SubSecTimeOriginal"), r"^\d+", 0), F.lit(3)), 3, "0").try_cast("long"), F.lit(0))
    return F.struct((values.exif_millis(F.coalesce(value("DateTimeOriginal"), value("DateTime"))) + sub).alias("time_ms"), F.trim(F.concat_ws(" ", value("Make"), value("Model"))).alias("camera"))


def png_fields(raw: bytes) -> list[tuple[str, str]]:
    """(keyword, text) of a PNG's text chunks; what is broken ends the list."""
    out, at = [], 8
    while raw[:8] == b"\x89PNG\r\n\x1a\n" and at + 12 <= len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if at + 12 + n > len(raw):
            break
        if kind in (b"tEXt", b"iTXt") and b"\0" in body:
            key, _, rest = body.partition(b"\0")
            text = rest if kind == b"tEXt" else rest[2:].split(b"\0", 2)[-1]
            out.append((key.decode("latin-1"), text.decode("latin-1" if kind == b"tEXt" else "utf-8", "replace")))
        at += 12 + n
    return out


def exif_fields(raw: bytes) -> list[tuple[str, str]]:
    """(tag, value) of ASCII entries of the first Exif directory in a JPEG or TIFF."""
    #: Tag numbers.
    names = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x9003: "DateTimeOriginal", 0x9291: "SubSecTimeOriginal"}
    start = raw.find(b"Exif\0\0") + 6 if raw[:2] == b"\xff\xd8" else 0
    t = raw[start:] if start != 5 else b""
    if t[:4] not in (b"II*\0", b"MM\0*") or len(t) < 8:
        return []
    order, out, seen = "<" if t[:2] == b"II" else ">", [], set()
    todo = [struct.unpack(order + "I", t[4:8])[0]]
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(t):
            continue
        seen.add(at)
        for k in range(struct.unpack(order + "H", t[at : at + 2])[0]):
            e = t[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(e) < 12:
                break
            tag, kind, n, value = struct.unpack(order + "HHII", e)
            if tag == 0x8769:
                todo.append(value)
            elif kind == 2 and tag in names:
                body = e[8 : 8 + n] if n <= 4 else t[value : value + n]
                out.append((names[tag], body.split(b"\0")[0].decode("utf-8", "replace")))
    return out


def xmp_fields(content: Column | str) -> Column:
    """(name, value) of the XMP packet in the first 256 KiB, whatever the container: attributes, and elements with text or a list's first item. No Python."""
    c = F.col(content) if isinstance(content, str) else content
    packet = F.regexp_extract(F.substring(c.cast("binary"), 1, 262_144).cast("string"), r"(?s)<x:xmpmeta.*?</x:xmpmeta>", 0)
    pairs = lambda pattern: F.arrays_zip(F.regexp_extract_all(packet, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(packet, F.lit(pattern), F.lit(2)).alias("value"))
    attributes = pairs(r"""\s(?!xmlns:)[A-Za-z]+:([A-Za-z]+)\s*=\s*"([^"]*)\"""")
    elements = pairs(r"(?s)<(?!rdf:)[A-Za-z]+:([A-Za-z]+)[^>/]*>\s*(?:<rdf:(?:Alt|Seq|Bag)>\s*<rdf:li[^>]*>)?([^<]*[^<\s][^<]*)<")
    return F.filter(F.concat(attributes, elements), lambda x: F.trim(x["value"]) != "")


def position(fields: Column | str) -> Column:
    """struct<lat, lon> of GPSLatitude and GPSLongitude or of a Location in ISO 6709; null if there is no valid one."""
    f = F.col(fields) if isinstance(fields, str) else fields
    value = lambda name: F.get(F.filter(f, lambda x: x["name"] == name), F.lit(0))["value"]
    lat, lon = values.xmp_coordinate(value("GPSLatitude")), values.xmp_coordinate(value("GPSLongitude"))
    return F.coalesce(F.when(values.valid_position(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon"))), values.iso6709(value("Location")))


def extract(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds fields (name, value, category) of PNG, JPEG and TIFF contents, and of XMP packets in any; other contents give none. Vectorised, a bad file gives none."""
    files = files.withColumn("_xmp", xmp_fields(content))
    kept = [c for c in files.columns if c != content]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for raw in pdf[content]:
                try:
                    got.append([{"name": k, "value": v} for k, v in png_fields(bytes(raw or b"")) + exif_fields(bytes(raw or b""))])
                except (ValueError, struct.error):
                    got.append([])
            yield pdf[kept].assign(fields=got)

    kinds_ = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name in kept)
    rows = files.mapInPandas(run, f"{kinds_}, fields array<struct<name: string, value: string>>")
    rows = rows.withColumn("fields", F.concat("fields", F.col("_xmp").cast("array<struct<name: string, value: string>>"))).drop("_xmp")
    return rows.withColumn("fields", F.transform("fields", lambda x: F.struct(x["name"].alias("name"), values.clean(x["value"]).alias("value"), class_of_tag(x["name"]).alias("category"))))


def sensitive(extracted: DataFrame) -> DataFrame:
    """Files with a classified field: their categories, sorted, and the first 24 such fields."""
    some = F.filter("fields", lambda x: x["category"].isNotNull())
    return extracted.withColumn("categories", F.array_sort(F.array_distinct(F.transform(some, lambda x: x["category"])))).withColumn("fields", F.slice(some, 1, MAX_FIELDS)).where(F.size("categories") > 0)
