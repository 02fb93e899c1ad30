"""The archive source and sink, and states from a stream that is stopped and started again."""

import glob
import os
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vocalith.sources import archives
from vocalith.streaming import overlay


def test_checksums_combine():
    data = bytes(range(256)) * 40
    for cut in (0, 1, 7, 4096, len(data)):
        a, b = data[:cut], data[cut:]
        assert archives.combined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(data)


def made(spark, n=2000, parts=5):
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "in/b_1.txt").otherwise("a_1.txt").alias("entry"), F.concat(F.lit("zeile ä\t"), F.col("id")).alias("line"), "id")
    return rows.repartition(parts)


def test_an_archive_holds_its_rows_in_order(spark, tmp_path):
    path = tmp_path / "x.zip"
    archives.write_entries(made(spark), path, ["id"])
    assert os.listdir(tmp_path) == ["x.zip"]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        assert z.namelist() == ["a_1.txt", "in/b_1.txt"]
        assert z.read("in/b_1.txt").decode().split("\n") == [*[f"zeile ä\t{i}" for i in range(0, 2000, 3)], ""]
        assert z.read("a_1.txt").decode().split("\n")[:-1] == [f"zeile ä\t{i}" for i in range(2000) if i % 3]
    archives.write_entries(made(spark, 6), path, ["id"])
    with zipfile.ZipFile(path) as z:
        assert z.read("in/b_1.txt").decode() == "zeile ä\t0\nzeile ä\t3\n"
    archives.write_entries(made(spark, 0), tmp_path / "none.zip", ["id"])
    with zipfile.ZipFile(tmp_path / "none.zip") as z:
        assert z.namelist() == []


def test_a_plain_file_is_the_joined_ranges(spark, tmp_path):
    archives.write_entries(made(spark).withColumn("entry", F.lit("")), tmp_path / "x.txt", ["id"], packed=False)
    assert (tmp_path / "x.txt").read_text() == "".join(f"zeile ä\t{i}\n" for i in range(2000))


def test_each_entry_of_a_kind_is_a_partition(spark, tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(4):
            z.writestr(f"some/where/row_{i}.txt", "".join(f"{i}:{n}\r\n" for n in range(i * 70_000)))
        z.writestr("other.txt", "no")
    lines = archives.archive_lines(spark, str(path), {"row": "row_"})
    assert lines.rdd.getNumPartitions() == 4
    assert lines.select("kind").distinct().collect()[0].kind == "row"
    assert lines.count() == 6 * 70_000
    assert sorted(r.line for r in lines.filter("line like '1:%'").limit(3).collect())[0].startswith("1:")
    with pytest.raises(Exception, match="missing"):
        archives.archive_lines(spark, str(tmp_path / "missing.zip"), {"row": "row_"}).count()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = made(spark).withColumn("line", F.when(F.col("id") == 1999, F.raise_error(F.lit("stop"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="stop"):
        archives.write_entries(bad, tmp_path / "x.zip", ["entry"])
    assert os.listdir(tmp_path) == []


def written(folder):
    return sum(os.path.getsize(p) for p in glob.glob(f"{folder}/**/*.changelog", recursive=True))


def test_states_survive_a_restart_and_write_what_changes(spark, tmp_path):
    schema = "k long, t long, v string, active boolean"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
        query = overlay.apply_deltas(stream, str(tmp_path / "changes"), ["k"], ["t", "v"], str(tmp_path / "cp"))
        query.awaitTermination()
        return {tuple(r) for r in overlay.states(spark, str(tmp_path / "cp"), stream.columns, ["k"]).collect()}

    put([(i, 1, f"a{i}", True) for i in range(5000)])
    first = run()
    assert len(first) == 5000
    before = written(tmp_path / "cp")
    put([(7, 2, "later", True), (8, 0, "too early", False), (9, 1, "b", False), (9000, 1, "new", True)])
    now = run()
    assert now == first - {(7, 1, "a7", True), (9, 1, "a9", True)} | {(7, 2, "later", True), (9, 1, "b", False), (9000, 1, "new", True)}
    # one row for each component that a batch names, at most, and not the whole state
    changed = {tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "changes/1")).collect()}
    assert changed == {(7, 2, "later", True), (8, 1, "a8", True), (9, 1, "b", False), (9000, 1, "new", True)}
    assert written(tmp_path / "cp") - before < before / 10
    assert run() == now


def test_an_entry_is_read_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "PIECE", 200)
    monkeypatch.setattr(archives, "LINES", 5)
    writer = archives.ArchiveWriter(str(path := tmp_path / "pieces.zip"), True)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Context", (), {"partitionId": lambda self: 0})())
    texts = [f"{i} {'x' * (i % 40)} ä" for i in range(100)]
    rows = pa.table({"entry": ["a/row_1.txt"] * 60 + ["b/row_2.txt"] * 40, "line": texts})
    writer.commit([writer.write(iter(rows.to_batches()))])
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        assert z.read("a/row_1.txt").decode() == "".join(f"{x}\n" for x in texts[:60])
    reader = archives.ArchiveReader(str(path), {"row": "row_"})
    parts = reader.partitions()
    assert len(parts) > 6
    assert [x for p in parts for b in reader.read(p) for x in b.column(1).to_pylist()] == texts
    monkeypatch.setattr(archives, "MOST", 3)
    few = archives.ArchiveWriter(str(path), True)
    few.commit([few.write(iter(rows.to_batches()))])
    parts = reader.partitions()
    assert len(parts) <= 6
    assert [x for p in parts for b in reader.read(p) for x in b.column(1).to_pylist()] == texts


def test_no_task_sorts_an_archive(spark, tmp_path):
    """A table with a folder for each kind is written from a sort of each task's rows, that is of a whole entry."""
    from vocalith.sources import releases

    archives.write_entries(spark.createDataFrame([("sct2_Concept_Snapshot.txt", "1\t20200101\t1\t2\t3")], "entry string, line string"), path := f"{tmp_path}/r.zip", ["line"])
    raw = releases.read_raw(spark, [path])
    assert [r.id for r in raw["concept"].collect()] == [1] and raw["relationship"].isEmpty()
    assert all("kind=" not in f for f in raw["concept"].inputFiles())
