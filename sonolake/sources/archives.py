"""Archives by ranges: tar and zip shards are listed by their headers alone, and members are read at their places.

A listing is a DataFrame of one row per member. Filters on it come before any content is read, and what is left is dealt out by
stretches of a shard, so that a shard of any size is the work of many tasks and no task or row holds a whole one. A lost task
seeks to its members again. Compressed tars have no places to seek to: each is read from its start by one task, member by member.
"""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a shard that one task reads (a member belongs to the stretch that it starts in).
STRETCH = 128 << 20
#: Contents that are handed over to Spark together.
BATCH = 32 << 20
#: A binary value of a row holds no more.
MEMBER_BYTES = 2_000_000_000
ZIP_STARTS = (b"PK\3\4", b"PK\5\6")
LISTING = "shard string, pos int, name string, key string, ext string, offset long, length long, kind string"

Opener = Callable[[str], BinaryIO]


def open_path(path: str) -> BinaryIO:
    """A file that can seek: on a local disk, or in a store that pyarrow knows. For other stores give an opener of your own."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return open("/" + (rest or path).lstrip("/"), "rb")
    from pyarrow.fs import FileSystem

    store, name = FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1) if scheme == "s3a" else path, safe=":/@"))
    return store.open_input_file(name)


def files(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """path, length of files; their bytes stay where they are. Files of no bytes have no row, as Spark's file sources leave them out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")


def members_of(f: BinaryIO) -> Iterator[tuple[str, int, int, str]]:
    """name, offset, length, kind of an archive's files in its order. Kinds: stored (the bytes are there), zip (a local header is
    there), packed (the offset counts uncompressed bytes)."""
    start = f.read(4)
    f.seek(0)
    if start in ZIP_STARTS:
        with zipfile.ZipFile(f) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield m.filename, m.header_offset, m.file_size, "zip"
        return
    with tarfile.open(fileobj=f) as t:
        kind = "stored" if t.fileobj is f else "packed"
        while (m := t.next()) is not None:
            t.members.clear()  # a header is needed once; a shard may have millions
            if m.isfile():
                if m.issparse():
                    raise ValueError(f"a sparse member: {m.name}")
                yield m.name, m.offset_data, m.size, kind


def listing(spark: SparkSession, path: str | list[str], extensions: tuple[str, ...] = (), opener: Opener = open_path) -> DataFrame:
    """shard, pos, name, key, ext, offset, length, kind of the members of tar and zip shards, with these extensions if any are given;
    pos counts the members listed, from 0, and a stem's periods become underscores in key. Reads headers only. A file that is
    no archive is an error; an empty archive has no rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column("path").to_pylist():
                found = []
                with opener(shard) as f:
                    pos = 0
                    for name, *place in members_of(f):
                        head, _, ext = name.rpartition("/")[2].rpartition(".")
                        if extensions and ext not in extensions:
                            continue
                        found.append((shard, pos, name, head.replace(".", "_"), ext, *place))
                        pos += 1
                        if len(found) == 10_000:
                            yield _batch(found)
                            found = []
                if found:
                    yield _batch(found)

    return files(spark, path).mapInArrow(rows, LISTING)


def _batch(found: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in LISTING.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)


def contents(listed: DataFrame, wanted: Column | None = None, stretch: int = STRETCH, tasks: int | None = None, opener: Opener = open_path) -> DataFrame:
    """Rows of a listing (other columns and filters are the caller's) with content: the bytes of the members that wanted holds for
    (all, if it is not given), null for others. A task reads the wanted members of some stretches in the order of their places.
    tasks: into how many tasks stretches are dealt, else the session's number of shuffle partitions; it sets no bound on rows.
    A wanted member over MEMBER_BYTES is an error, as no row can hold it."""
    n = tasks or int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.when(F.col("kind") != "packed", F.expr(f"offset div {int(stretch)}")).otherwise(F.lit(0))
    d = listed.withColumn("_wanted", F.coalesce(F.lit(True) if wanted is None else wanted, F.lit(False)))
    d = d.withColumn("_place", place).repartition(n, "shard", "_place").sortWithinPartitions("shard", "offset").drop("_place")
    if "content" in listed.columns:
        raise ValueError("the listing has a column content already")
    schema = d.drop("_wanted").schema.add("content", "binary")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Shard(opener) as shard:
            for b in batches:
                at = {c: b.column(c).to_pylist() for c in ("shard", "name", "offset", "length", "kind", "_wanted")}
                kept = b.select([c for c in b.schema.names if c != "_wanted"])
                start, held, size = 0, [], 0
                for i, row in enumerate(zip(*at.values(), strict=True)):
                    held.append(shard.read(*row[:-1]) if row[-1] else None)
                    size += len(held[-1] or b"")
                    if size >= BATCH or i == b.num_rows - 1:
                        part = kept.slice(start, len(held))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*part.schema.names, "content"])
                        start, held, size = i + 1, [], 0

    return d.mapInArrow(rows, schema)


class _Shard:
    """The shard that a task reads at the moment; places of one shard come in ascending order, so a packed one is read once."""

    def __init__(self, opener: Opener) -> None:
        self.opener, self.path, self.open = opener, None, []

    def __enter__(self) -> _Shard:
        return self

    def __exit__(self, *_: object) -> None:
        for f in reversed(self.open):
            f.close()
        self.open = []

    def read(self, path: str, name: str, offset: int, length: int, kind: str) -> bytes:
        if length > MEMBER_BYTES:
            raise ValueError(f"a member over {MEMBER_BYTES} bytes: {name} of {path}")
        if path != self.path:
            self.__exit__()
            self.path, f = path, self.opener(path)
            self.open = [f]
            if kind == "zip":
                self.open.append(zipfile.ZipFile(f))
                self.infos = {m.header_offset: m for m in self.open[-1].infolist()}
            elif kind == "packed":
                self.open.append(tarfile.open(fileobj=f))
        if kind == "zip":
            return self.open[-1].read(self.infos[offset])
        f = self.open[-1].fileobj if kind == "packed" else self.open[-1]
        f.seek(offset)
        raw = f.read(length)
        if len(raw) < length:
            raise ValueError(f"{path} ends within {name}")
        return raw
