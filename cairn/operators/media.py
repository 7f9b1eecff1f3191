"""What containers of videos declare: codecs, size and length, and whether they can be played. No frame is decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from ..functions import kinds

#: Codecs that can be played, by container.
PLAYABLE = {"mp4": "avc1 avc3 hvc1 mp4v jpeg mjpa apch apcn apcs apco ap4h ap4x".split(), "webm": ["V_VP8", "V_VP9"]}
MAX_BOXES, MAX_TRACKS, MAX_EDGE = 4096, 64, 16_384
#: Element ids of Matroska.
_EBML = {"segment": 0x18538067, "info": 0x1549A966, "scale": 0x2AD7B1, "duration": 0x4489, "tracks": 0x1654AE6B, "track": 0xAE, "type": 0x83, "codec": 0x86, "video": 0xE0, "width": 0xB0, "height": 0xBA}


def boxes(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, payload) of a run of boxes; a size that does not fit is an error."""
    at = 0
    for _ in range(MAX_BOXES):
        if at + 8 > len(raw):
            return
        size, kind = struct.unpack_from(">I4s", raw, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", raw, at + 8)[0], 16
        size = len(raw) - at if size == 0 else size
        if size < head or at + size > len(raw):
            raise ValueError("a box does not fit")
        yield kind, raw[at + head : at + size]
        at += size


def _mp4(raw: bytes) -> dict:
    moov = dict(reversed(list(boxes(raw))))[b"moov"]
    out: dict = {"duration_ms": 0}
    top = list(boxes(moov))
    for kind, body in top:
        if kind == b"mvhd":
            scale, length = struct.unpack_from(">IQ", body, 20) if body[0] == 1 else struct.unpack_from(">II", body, 12)
            out["duration_ms"] = length * 1000 // scale if scale and length not in (2**32 - 1, 2**64 - 1) else 0
    tracks = [b for k, b in top if k == b"trak"]
    if not 0 < len(tracks) <= MAX_TRACKS:
        raise ValueError("no tracks")
    for trak in tracks:
        t = dict(boxes(trak))
        mdia = dict(boxes(t[b"mdia"]))
        entry = dict(boxes(dict(boxes(mdia[b"minf"]))[b"stbl"]))[b"stsd"]
        codec, body = next(boxes(entry[8:]))
        handler = mdia[b"hdlr"][8:12]
        if handler == b"vide" and "video" not in out:
            w, h = struct.unpack_from(">HH", body, 24)
            at = 52 if t.get(b"tkhd", b"\0")[0] == 1 else 40
            m = struct.unpack_from(">9i", t[b"tkhd"], at) if len(t.get(b"tkhd", b"")) >= at + 36 else (1,) * 9
            turned = m[0] == m[4] == 0 and m[1] and m[3]  # stored lying, shown upright
            out |= {"video": codec, "w": h if turned else w, "h": w if turned else h}
        elif handler == b"soun":
            out.setdefault("audio", codec)
    return out


def _elements(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(id, payload) of a run of EBML elements; the last one may be cut off."""
    at = 0
    while at < len(raw):
        n = 9 - raw[at].bit_length()
        key = int.from_bytes(raw[at : at + n])
        at += n
        if n > 4 or at >= len(raw) or not raw[at]:
            return
        n = 9 - raw[at].bit_length()
        size = int.from_bytes(raw[at : at + n]) & ((1 << 7 * n) - 1)
        at += n
        yield key, raw[at:] if size == (1 << 7 * n) - 1 else raw[at : at + size]
        at += size


def _webm(raw: bytes) -> dict:
    top = dict(_elements(raw))
    out: dict = {"duration_ms": 0}
    for key, body in _elements(top[_EBML["segment"]]):
        if key == _EBML["info"]:
            info = dict(_elements(body))
            raw_length = info.get(_EBML["duration"], b"")
            length = struct.unpack(">f" if len(raw_length) == 4 else ">d", raw_length)[0] if len(raw_length) in (4, 8) else 0
            out["duration_ms"] = int(length * int.from_bytes(info.get(_EBML["scale"], b"\x0f\x42\x40")) / 1e6)
        elif key == _EBML["tracks"]:
            for k, track in _elements(body):
                t = dict(_elements(track)) if k == _EBML["track"] else {}
                kind = int.from_bytes(t.get(_EBML["type"], b""))
                if kind == 1 and "video" not in out:
                    v = dict(_elements(t.get(_EBML["video"], b"")))
                    out |= {"video": t[_EBML["codec"]], "w": int.from_bytes(v.get(_EBML["width"], b"")), "h": int.from_bytes(v.get(_EBML["height"], b""))}
                elif kind == 2:
                    out.setdefault("audio", t[_EBML["codec"]])
            return out
    raise ValueError("no tracks")


@F.pandas_udf(StructType().add("ok", BooleanType()).add("video", StringType()).add("audio", StringType()).add("w", IntegerType()).add("h", IntegerType()).add("duration_ms", LongType()))
def _probe(contents: pd.Series, classes: pd.Series) -> pd.DataFrame:
    rows = []
    for raw, kind in zip(contents, classes, strict=True):
        try:
            found = _webm(raw) if kind == "webm" else _mp4(raw)
            rows.append((True, *(found[k].decode("ascii", "replace") if k in found else None for k in ("video", "audio")), found.get("w", 0), found.get("h", 0), found["duration_ms"]))
        except (ValueError, KeyError, IndexError, StopIteration, struct.error, TypeError):
            rows.append((False, None, None, 0, 0, 0))
    return pd.DataFrame(rows, columns=["ok", "video", "audio", "w", "h", "duration_ms"]).astype({"ok": bool, "w": "int32", "h": "int32", "duration_ms": "int64"})


def probe(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds container, video, audio (codecs), w, h, duration_ms and video_status of contents (with ext); other contents have no container and are damaged."""
    c = F.col(content).cast("binary")
    rows = files.withColumn("_class", kinds.sniff(c, "ext"))
    film = F.col("_class").isin("mp4", "mov", "webm")
    rows = rows.withColumn("_p", F.when(film, _probe(F.when(film, c).otherwise(F.lit(b"")), F.col("_class"))))
    rows = rows.withColumn("container", F.when(F.col("_class") == "mp4", "MP4").when(F.col("_class") == "mov", "QuickTime").when(F.col("_class") == "webm", "WebM"))
    rows = rows.withColumns({k: F.col(f"_p.{k}") for k in ("video", "audio", "w", "h", "duration_ms")})
    return rows.withColumn("video_status", video_status(F.col("_class"), F.coalesce(F.col("_p.ok"), F.lit(False)))).drop("_class", "_p")


def video_status(sniffed: Column, ok: Column, blocked: Column | None = None) -> Column:
    """playable, unsupported-codec, no-video, damaged or blocked, from columns video, w and h."""
    allowed = F.when(sniffed == "webm", F.col("video").isin(PLAYABLE["webm"])).otherwise(F.col("video").isin(PLAYABLE["mp4"]))
    sized = F.col("w").between(1, MAX_EDGE) & F.col("h").between(1, MAX_EDGE)
    status = F.when(~ok, "damaged").when(F.col("video").isNull(), "no-video").when(~allowed, "unsupported-codec").when(~sized, "damaged").otherwise("playable")
    return status if blocked is None else F.when(blocked, "blocked").otherwise(status)
