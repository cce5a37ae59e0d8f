"""Archives read by ranges: rows as whole-file reading gives them, headers alone for listings, one shard in many tasks."""

import io
import tarfile
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sonolake.sources import archives, readers


def add(tar, name, raw):
    info = tarfile.TarInfo(name)
    info.size = len(raw)
    tar.addfile(info, io.BytesIO(raw))


def test_rows_of_all_kinds_equal_a_whole_reading(spark, tmp_path):
    members = [("d/a.1.wav", b"sound" * 50), ("d/a.1.txt", "één".encode()), ("noext", b""), ("x" * 150 + ".txt", b"a long name"), ("a b%20c.txt", b"\0\1")]
    for name, mode in (("plain.tar", "w"), ("packed.tar.gz", "w:gz"), ("packed.tar.xz", "w:xz"), ("pax one.tar", "w")):
        with tarfile.open(tmp_path / name, mode, format=tarfile.PAX_FORMAT if "pax" in name else tarfile.GNU_FORMAT) as t:
            folder = tarfile.TarInfo("d")
            folder.type = tarfile.DIRTYPE
            t.addfile(folder)
            for m in members:
                add(t, *m)
    for name, method in (("stored.zip", zipfile.ZIP_STORED), ("deflated.zip", zipfile.ZIP_DEFLATED)):
        with zipfile.ZipFile(tmp_path / name, "w", method) as z:
            z.mkdir("d")
            for m in members:
                z.writestr(*m)
    tarfile.open(tmp_path / "empty.tar", "w").close()
    zipfile.ZipFile(tmp_path / "empty.zip", "w").close()
    got = archives.contents(archives.listing(spark, str(tmp_path)), stretch=256, tasks=7).collect()
    for shard in ("plain.tar", "packed.tar.gz", "packed.tar.xz", "pax one.tar", "stored.zip", "deflated.zip"):
        mine = sorted((r.pos, r.name, bytes(r.content)) for r in got if r.shard.endswith("/" + shard))
        assert mine == [(i, n, raw) for i, (n, raw) in enumerate(members)], shard
    assert len(got) == 6 * len(members)
    assert {(r.key, r.ext) for r in got if r.pos == 0} == {("a_1", "wav")} and {(r.key, r.ext) for r in got if r.pos == 2} == {("", "noext")}


def test_repeated_names_keep_their_own_bytes(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        add(t, "a.txt", b"one")
        add(t, "a.txt", b"two")
    with pytest.warns(UserWarning), zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("a.txt", b"one")
        z.writestr("a.txt", b"two")
    got = readers.archive_members(spark, str(tmp_path)).collect()
    assert sorted((r.shard[-3:], r.pos, bytes(r.content)) for r in got) == [(k, i, c) for k in ("tar", "zip") for i, c in ((0, b"one"), (1, b"two"))]


def test_a_shard_beyond_two_gigabytes_by_its_headers(spark, tmp_path):
    """A file with holes: 3 GB of samples, then a transcript. Tasks that read over 100 kB of it fail."""
    path = tmp_path / "large.tar"
    with open(path, "wb") as f:
        for name, raw, size in (("u.wav", b"RIFF", 3 << 30), ("u.txt", b"the words", 9)):
            info = tarfile.TarInfo(name)
            info.size = size
            f.write(info.tobuf(tarfile.GNU_FORMAT))
            after = f.tell() + -(-size // 512) * 512
            f.write(raw)
            f.seek(after)
        f.write(bytes(1024))

    def opener(name):
        class Counted(io.FileIO):
            left = 100_000

            def read(self, n=-1):
                raw = super().read(n)
                self.left -= len(raw)
                assert self.left > 0, "too much was read"
                return raw

        return Counted("/" + name.removeprefix("file:").lstrip("/"))

    assert [(r.pos, r.name) for r in readers.archive_names(spark, str(tmp_path), opener=opener).collect()] == [(0, "u.wav")]
    got = readers.archive_members(spark, str(tmp_path), ("txt",), opener=opener).collect()
    assert sorted((r.ext, r.content) for r in got) == [("txt", bytearray(b"the words")), ("wav", None)]
    listed = archives.listing(spark, str(tmp_path), opener=opener)
    assert [r.content for r in archives.contents(listed.where("ext = 'txt'"), opener=opener).collect()] == [bytearray(b"the words")]
    with pytest.raises(PySparkException, match="a member over 2000000000 bytes: u.wav"):
        archives.contents(listed).collect()


def test_one_shard_is_the_work_of_several_tasks(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        for i in range(200):
            add(t, f"{i:03}.txt", str(i).encode() * 100)
    d = archives.contents(archives.listing(spark, str(tmp_path)), F.col("pos") % 2 == 0, stretch=20_000, tasks=8)
    rows = d.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > 2 and len(rows) == 200
    assert all(r.content == (str(r.pos).encode() * 100 if r.pos % 2 == 0 else None) for r in rows)


def test_damaged_shards_are_errors_and_content_may_not_clash(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "s.tar").write_bytes(b"no archive at all")
    with pytest.raises(PySparkException, match="ReadError"):
        archives.listing(spark, str(tmp_path / "n")).collect()
    with tarfile.open(tmp_path / "cut.tar", "w") as t:
        add(t, "a.txt", b"x" * 5000)
    raw = (tmp_path / "cut.tar").read_bytes()
    listed = archives.listing(spark, str(tmp_path / "cut.tar")).collect()
    (tmp_path / "cut.tar").write_bytes(raw[:2000])
    again = spark.createDataFrame(listed, archives.LISTING)
    with pytest.raises(PySparkException, match="ends within a.txt"):
        archives.contents(again).collect()
    with pytest.raises(ValueError, match="a column content"):
        archives.contents(again.withColumn("content", F.lit(1)))


def test_headers_of_sound_files_behind_other_chunks(spark, tmp_path):
    body = b"LIST" + (5).to_bytes(4, "little") + b"abcde\0" + b"fmt " + (18).to_bytes(4, "little") + b"\1\0\2\0" + (8000).to_bytes(4, "little") + (32000).to_bytes(4, "little") + b"\4\0\x10\0" + b"\0\0"
    with open(tmp_path / "a b.wav", "wb") as f:
        f.write(b"RIFF" + bytes(4) + b"WAVE" + body + b"data" + (3 << 30).to_bytes(4, "little"))
        f.truncate(3 << 30)
    (tmp_path / "short.wav").write_bytes(b"RIFF")
    got = {r.fname.rpartition("/")[2]: (r.channels, r.sample_rate, r.bitdepth, r.num_samples) for r in readers.audio_metadata(spark, str(tmp_path)).collect()}
    assert got == {"a b.wav": (2, 8000, 16, (3 << 30) // 4), "short.wav": (None,) * 4}
