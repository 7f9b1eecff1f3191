"""Entries of zip, tar and gzip archives as rows; nothing is extracted to disk. Python reads one archive's headers, Spark deals archives and judges entries."""

from __future__ import annotations

import gzip
import io
import stat
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Entries of an archive, levels of archives in archives, and bytes of a nested one and of all that are unpacked to look inside. Beyond them a listing is marked as partial.
MAX_ENTRIES, MAX_DEPTH, MAX_NESTED, MAX_INFLATED = 200_000, 3, 64 << 20, 512 << 20
SCHEMA = "archive string, parent string, depth int, path string, size long, packed long, is_dir boolean, is_link boolean, encrypted boolean, nested boolean, partial boolean"
#: Names of archives that are not looked into.
OTHERS = (".zip", ".tar", ".tgz", ".gz", ".jar", ".apk", ".7z", ".rar", ".xz", ".bz2", ".cab", ".iso", ".dmg")


def _format(head: bytes) -> str | None:
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    return "gzip" if head[:2] == b"\x1f\x8b" else "tar" if head[257:262] == b"ustar" else None


class _Listing:
    """The rows of one archive, level by level, within its limits."""

    def __init__(self, name: str):
        self.name, self.count, self.inflated = name, 0, 0

    def rows(self, raw: bytes, parent: str, depth: int) -> Iterator[tuple]:
        kind = _format(raw[:512])
        try:
            members = {"zip": self._zip, "tar": self._tar, "gzip": self._gzip}[kind](raw, parent)
            for path, size, packed, is_dir, is_link, encrypted, read in members:
                if self.count >= MAX_ENTRIES:
                    yield self._partial(parent, depth)
                    return
                self.count += 1
                inner, cut = b"", False
                looks = not is_dir and not is_link and path.lower().endswith(OTHERS)
                if looks and not encrypted and size <= MAX_NESTED and depth + 1 < MAX_DEPTH + 1:
                    if self.inflated + size <= MAX_INFLATED:
                        inner = read()
                        self.inflated += len(inner)
                    else:
                        cut = True
                nested = looks or _format(inner[:512]) is not None
                yield self.name, parent, depth, path, size, packed, is_dir, is_link, encrypted, nested, cut
                if _format(inner[:512]) and depth < MAX_DEPTH:
                    yield from self.rows(inner, f"{parent}{path}!", depth + 1)
        except (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, OSError, ValueError, KeyError, NotImplementedError, RuntimeError):
            yield self._partial(parent, depth)

    def _partial(self, parent: str, depth: int) -> tuple:
        return self.name, parent, depth, None, 0, 0, False, False, False, False, True

    @staticmethod
    def _zip(raw: bytes, parent: str) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for i in z.infolist():
                yield i.filename, i.file_size, i.compress_size, i.is_dir(), stat.S_ISLNK(i.external_attr >> 16), bool(i.flag_bits & 1), lambda i=i: z.open(i).read(MAX_NESTED)

    @staticmethod
    def _tar(raw: bytes, parent: str) -> Iterator[tuple]:
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:") as t:
            for i in t:
                yield i.name, i.size, i.size, i.isdir(), i.issym() or i.islnk(), False, lambda i=i: (t.extractfile(i) or io.BytesIO()).read(MAX_NESTED)

    def _gzip(self, raw: bytes, parent: str) -> Iterator[tuple]:
        """A tar within is listed in its stead; else the one file that it holds."""
        with gzip.GzipFile(fileobj=io.BytesIO(raw)) as g:
            inner = g.read(min(MAX_NESTED, MAX_INFLATED - self.inflated))
            self.inflated += len(inner)
            if _format(inner[:512]) == "tar":
                yield from self._tar(inner, parent)
                return
            size = len(inner)
            while more := g.read(1 << 20):  # only counted
                size += len(more)
        name = self.name.rsplit("/", 1)[-1]
        yield name.removesuffix(".gz"), size, len(raw), False, False, False, lambda: inner


def entries(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """The entries of archives in rows of SCHEMA; other contents give none, broken ones a partial row. ``parent`` leads through nested archives."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            for archive, raw in zip(pdf[name], pdf[content], strict=True):
                if raw is not None and _format(raw[:512]):
                    held: list[tuple] = []
                    for row in _Listing(archive).rows(bytes(raw), "", 0):
                        held.append(row)
                        if len(held) == 10_000:
                            yield pd.DataFrame(held, columns=columns)
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=columns)

    return files.select(name, content).mapInPandas(run, SCHEMA)
