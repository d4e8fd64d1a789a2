"""What MP4 containers declare, found by skipping from box to box: tasks read headers and small tables, never whole videos."""

from __future__ import annotations

import hashlib
import io
import os
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.session import ship_package

#: Fixed values of the format: boxes that hold boxes on the way to the sample tables.
HOLDERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
#: The sample tables; both keep their count in the bytes 8 to 12.
SAMPLE_TABLES = (b"stsz", b"stz2")
CHUNK = 1 << 20
TRACK = "struct<handler:string,timescale:long,duration:long,samples:long>"
FACTS = f"header_ok boolean, tracks array<{TRACK}>, sample_counts array<long>, damage string, sha256 string"


def boxes(f: BinaryIO, size: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of its content, its end) of each box, a holder before what it holds. Reads headers only. A box that is
    shorter than its header or longer than its holder is given as kind b"" and ends its holder."""
    at, ends = 0, [size]
    while ends:
        if at + 8 > ends[-1]:
            at = ends.pop()
            continue
        f.seek(at)
        head = f.read(16)
        length, kind, start = int.from_bytes(head[:4]), head[4:8], at + 8
        if length == 1:  # the length is in the next eight bytes
            length, start = int.from_bytes(head[8:16]), at + 16
        end = ends[-1] if length == 0 else at + length
        if end < start or end > ends[-1]:
            yield b"", at, ends[-1]
            at = ends.pop()
            continue
        yield kind, start, end
        if kind in HOLDERS:
            ends.append(end)
            at = start
        else:
            at = end


def _field(f: BinaryIO, start: int, end: int, at: int, n: int) -> int:
    f.seek(start + at)
    return int.from_bytes(f.read(n)) if start + at + n <= end else 0


def _tracks(f: BinaryIO, size: int) -> tuple[list[dict], str | None]:
    tracks, damage = [], None
    for kind, start, end in boxes(f, size):
        if kind == b"":
            damage = damage or f"box at {start} does not fit"
        elif kind == b"trak":
            tracks.append({"handler": None, "timescale": None, "duration": None, "samples": None})
        elif not tracks:
            continue
        elif kind == b"hdlr":
            f.seek(start + 8)
            tracks[-1]["handler"] = f.read(4).decode("latin-1")
        elif kind == b"mdhd":
            wide = _field(f, start, end, 0, 1) == 1
            tracks[-1]["timescale"] = _field(f, start, end, 20 if wide else 12, 4)
            tracks[-1]["duration"] = _field(f, start, end, 24 if wide else 16, 8 if wide else 4)
        elif kind in SAMPLE_TABLES:
            tracks[-1]["samples"] = _field(f, start, end, 8, 4)
    return tracks, damage


def _stream(f: BinaryIO, scan: bool) -> tuple[str, list[int]]:
    """SHA-256 and, where scan is set, the counts behind every mark of a sample table, in pieces of one MB."""
    digest, counts, rest = hashlib.sha256(), [], b""
    f.seek(0)
    while piece := f.read(CHUNK):
        digest.update(piece)
        if scan:
            text = rest + piece
            at = text.find(b"stsz")
            while at >= 0 and at + 16 <= len(text):
                counts.append(int.from_bytes(text[at + 12 : at + 16]))
                at = text.find(b"stsz", at + 4)
            rest = text[at:] if at >= 0 else text[-3:]
    return digest.hexdigest().upper(), [n for n in counts if n > 0]


def facts(f: BinaryIO, size: int, digest: bool = True) -> tuple:
    """The columns of FACTS. Where no track has a sample table, counts are searched for in all bytes."""
    f.seek(0)
    header_ok = size >= 12 and b"ftyp" in f.read(32)
    tracks, damage = _tracks(f, size)
    counts = [t["samples"] for t in tracks if t["samples"]]
    sha = None
    if digest or not counts:
        sha, found = _stream(f, scan=not counts)
        counts = counts or found
    return header_ok, tracks, counts, damage, sha if digest else None


def _open(path: str) -> BinaryIO:
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return open("/" + rest.lstrip("/") if rest else path, "rb")
    host, _, name = rest.lstrip("/").partition("/")
    store, top = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return store.open_input_file(f"{top.rstrip('/')}/{name}")


def open_file(path: str) -> bytes:
    """All bytes of a small file, as an image."""
    with _open(path) as f:
        return f.read()


def _length(f: BinaryIO) -> int:
    return f.seek(0, os.SEEK_END)


def _with_facts(rows: DataFrame, column: str, opened, digest: bool) -> DataFrame:
    ship_package(rows.sparkSession)
    names = [p.split()[0] for p in FACTS.split(", ")]

    @F.pandas_udf(f"struct<{', '.join(p.replace(' ', ':', 1) for p in FACTS.split(', '))}>")
    def look(s: pd.Series) -> pd.DataFrame:
        out = []
        for v in s:
            if v is None:
                out.append((None, None, None, None, None))
                continue
            with opened(v) as f:
                out.append(facts(f, _length(f), digest))
        return pd.DataFrame(out, columns=names)

    return rows.withColumn("_facts", look(column)).select(*rows.columns, "_facts.*")


def container_facts(rows: DataFrame, column: str = "content", digest: bool = False) -> DataFrame:
    """Rows with the columns of FACTS for containers held in a binary column; all null where that is null. No bytes: no
    header, no track."""
    return _with_facts(rows, column, io.BytesIO, digest)


def read_containers(spark: SparkSession, root: str, digest: bool = True) -> DataFrame:
    """path, relative (its part below root), name, size and FACTS of the MP4 files below root. Spark lists and deals files by
    size; tasks open them by path, in any file system that pyarrow knows, and seek. digest: SHA-256, in pieces of one MB."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp4").load(root).select("path", F.col("length").alias("size"))
    return _with_facts(listed, "path", _open, digest).select("path", relative("path", root).alias("relative"), F.element_at(F.split("path", "/"), -1).alias("name"), "size", *[p.split()[0] for p in FACTS.split(", ")])


def relative(path: str, root: str) -> Column:
    """What follows root in a listed path."""
    below = root.partition(":")[2] or root
    return F.substring_index(F.col(path), "/" + below.strip("/") + "/", -1)


def frame_rate(track: Column) -> Column:
    """Samples a second of a track; null without a duration."""
    return F.when((track["duration"] > 0) & (track["timescale"] > 0), track["samples"] * track["timescale"] / track["duration"])
