"""ZIP archives by members: directories are listed first, then the members of all archives are dealt to tasks, which read each in pieces.

A task opens an archive where it lies and reads no more than its members'
bytes, a buffer at a time; neither an archive nor a member is held whole. Paths
are those that Arrow's file systems open (local and shared folders, HDFS, object
stores).
"""

from __future__ import annotations

import hashlib
import re
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUFFER = 1 << 20
#: Bytes of packed members that a task is dealt.
PER_TASK = 64 << 20
#: What a damaged archive or member raises: bad structure or checksum, unknown method, a password, an end too soon.
DAMAGED = (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError)
MEMBERS = "archive string, name string, at long, bytes long, packed long, crc long, safe boolean, error string"
_MEMBERS = pa.schema([("archive", pa.string()), ("name", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("packed", pa.int64()), ("crc", pa.int64()), ("safe", pa.bool_()), ("error", pa.string())])


class _File:
    """An Arrow file with the errors that zipfile looks for: a place before the beginning is an OSError."""

    def __init__(self, raw: pa.NativeFile):
        self.raw, self.read, self.tell, self.seekable = raw, raw.read, raw.tell, raw.seekable

    def seek(self, offset: int, whence: int = 0) -> int:
        place = offset + (self.raw.size() if whence == 2 else self.raw.tell() if whence == 1 else 0)
        if place < 0:
            raise OSError(f"no place {place}")
        return self.raw.seek(place)


def open_file(path: str) -> pa.NativeFile:
    """A file to be read at any place, by a path as Spark gives it."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    system, inner = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


@contextmanager
def _opened(path: str) -> Iterator[zipfile.ZipFile]:
    with open_file(path) as raw, zipfile.ZipFile(_File(raw)) as archive:
        yield archive


def safe_name(name: str) -> bool:
    """Whether a member stays below the folder that it is unpacked to: relative, no drive, no step upwards; a backslash counts as a slash."""
    parts = name.replace("\\", "/")
    return not (parts.startswith("/") or ".." in parts.split("/") or re.match("[A-Za-z]:", parts))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            try:
                with _opened(path) as archive:
                    rows = [(path, i.filename, i.header_offset, i.file_size, i.compress_size, i.CRC, safe_name(i.filename), None) for i in archive.infolist() if not i.is_dir()]
            except DAMAGED as e:
                rows = [(path, None, None, None, None, None, False, f"{type(e).__name__}: {e}")]
            yield _batch(rows, _MEMBERS)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, at (its place), bytes, packed, crc, safe, error: a row per member of every archive at a path, folders left out.

    Only directories are read, an archive a task. An archive that can't be listed
    is one row with its error; one without members has none. Two members of one
    name are two rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(_listed, MEMBERS)


def _dealt(members: DataFrame) -> DataFrame:
    """Members by tasks of about PER_TASK packed bytes."""
    total = members.agg(F.coalesce(F.sum("packed"), F.lit(0)).alias("b")).first()["b"]
    return members.repartition(max(1, -(-total // PER_TASK)), "archive", "at")


def _pieces(path: str, at: list[int]) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """(at, number, bytes, error) of the pieces of some members of an archive; an empty member has one empty piece, the last one tells what failed."""
    with _opened(path) as archive:
        by_place = {i.header_offset: i for i in archive.infolist()}
        for a in at:
            k = 0
            try:
                with archive.open(by_place[a]) as body:
                    while (got := body.read(BUFFER)) or not k:
                        yield a, k, got, None
                        k += 1
            except DAMAGED as e:
                yield a, k, None, f"{type(e).__name__}: {e}"


def _by_archive(batch: pa.RecordBatch) -> dict[str, list[int]]:
    wanted: dict[str, list[int]] = {}
    for path, a in zip(batch.column("archive").to_pylist(), batch.column("at").to_pylist(), strict=True):
        wanted.setdefault(path, []).append(a)
    return wanted


_PIECES = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("piece", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
_HASHES = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("sha256", pa.string()), ("failure", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, at in _by_archive(batch).items():
            for a, k, got, error in _pieces(path, sorted(at)):
                yield _batch([(path, a, k, got, error)], _PIECES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, at in _by_archive(batch).items():
            rows, digest = [], hashlib.sha256()
            for a, k, got, error in _pieces(path, sorted(at)):
                if k == 0:
                    digest = hashlib.sha256()
                if got is not None:
                    digest.update(got)
                if rows and rows[-1][1] == a:
                    rows.pop()
                rows.append((path, a, None if error else digest.hexdigest(), error))
            yield _batch(rows, _HASHES)


def zip_pieces(members: DataFrame) -> DataFrame:
    """archive, at, piece (from 0), content, error: the contents of safe members in pieces of at most BUFFER bytes.

    Checksums are verified as the last bytes are read: a member that fails ends
    with a piece without content that has the error, so what was read before
    mustn't be used without looking for it.
    """
    return _dealt(members.where("safe").select("archive", "at", "packed")).select("archive", "at").mapInArrow(_read, "archive string, at long, piece long, content binary, error string")


def zip_hashes(members: DataFrame) -> DataFrame:
    """The members with sha256, which is null for unsafe and damaged ones; error tells what failed. Nothing but hashes leaves a task."""
    found = _dealt(members.where("safe").select("archive", "at", "packed")).select("archive", "at").mapInArrow(_hashed, "archive string, at long, sha256 string, failure string")
    return members.join(found, ["archive", "at"], "left").select("archive", "name", "at", "bytes", "packed", "crc", "safe", "sha256", F.coalesce("error", "failure").alias("error"))


def _folder(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*/)?[^/]*$", 1)


def verify_checksums(members: DataFrame, listing: str = "CHECKSUMS.sha256") -> DataFrame:
    """archive, name, expected, actual, state of every file that a hash list inside an archive declares.

    A list is a member of that name in any folder; its lines are 64 hex digits,
    white space, `*` or blank, and a name relative to its folder, blank lines
    aside. state: matched, mismatch, missing (no such member that is safe and
    whole) or malformed (name is the line, or the list itself if it can't be
    read). The last of two lines for a name counts, and the last of two members.
    """
    slashed = F.replace("name", F.lit("\\"), F.lit("/"))
    named = members.withColumn("name", slashed)
    lists = named.where(F.regexp_extract("name", r"([^/]*)$", 1) == listing)
    by = zip_pieces(lists).groupBy("archive", "at").agg(F.array_sort(F.collect_list(F.struct("piece", "content"))).alias("p"), F.max("error").alias("failed"))
    text = F.decode(F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, F.coalesce(x["content"], F.lit(b"")))), "UTF-8")
    lines = by.join(lists.select("archive", "at", F.col("name").alias("list"), _folder(F.col("name")).alias("folder")), ["archive", "at"])
    lines = lines.select("archive", "at", "list", "folder", "failed", F.posexplode(F.when(F.col("failed").isNull(), F.split(F.ltrim(text, F.lit("\ufeff")), r"\r\n|\r|\n")).otherwise(F.array(F.col("list")))).alias("no", "line"))
    line = F.trim("line")
    digest = F.lower(F.regexp_extract(line, r"^([0-9a-fA-F]{64})\s+[* ]?(.+)$", 1))
    name = F.concat("folder", F.replace(F.regexp_extract(line, r"^([0-9a-fA-F]{64})\s+[* ]?(.+)$", 2), F.lit("\\"), F.lit("/")))
    rows = lines.where(line != "").select("archive", "at", "no", digest.alias("expected"), F.when(F.col("failed").isNull() & (digest != ""), name).alias("name"), line.alias("line"))
    bad = rows.where("name is null").select("archive", F.col("line").alias("name"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"), F.lit("malformed").alias("state"))
    declared = rows.where("name is not null").groupBy("archive", "name").agg(F.max_by("expected", F.struct("at", "no")).alias("expected"))
    wanted = named.join(declared.select("archive", "name"), ["archive", "name"], "left_semi")
    actual = zip_hashes(wanted).groupBy("archive", "name").agg(F.max_by("sha256", "at").alias("actual"))
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("expected"), "matched").otherwise("mismatch")
    return declared.join(actual, ["archive", "name"], "left").select("archive", "name", "expected", "actual", state.alias("state")).unionByName(bad)
