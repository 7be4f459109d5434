import hashlib
import os

from kinframe.plans import all_queries
from kinframe.plans.registry import runner
from kinframe.sources import catalog_io as io


def test_every_document_gets_its_own_file(spark, tmp_path):
    """Rows that share an id, or have none, stay rows of their own."""
    all_queries()
    rows = [(1, "a"), (1, "bc"), (1, "a"), (-7, "é\nx"), (300, ""), (None, "n"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = runner("s02_file_hashes")(spark, str(tmp_path)).collect()
    want = [(i, len(t.encode()) + 1, hashlib.sha256(t.encode() + b"\n").hexdigest()) for i, t in rows if t is not None]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_written_files_are_read_back(spark, tmp_path):
    rows = [("x/y/1.bin", b"\x00\xff"), ("x/2.bin", b"2"), ("3.bin", b"3\n"), ("x/none.bin", None), ("x/y/4.txt", b"no")]
    files = spark.createDataFrame(rows, "path string, content binary")
    for root in (f"{tmp_path}/plain", f"file://{tmp_path}/address", f"file:{tmp_path}/short"):
        assert io.write_files(files, root) == 5
        got = {r.path.rpartition("/")[2]: bytes(r.content) for r in io.read_files(spark, root, "*.bin").collect()}
        assert got == {"1.bin": b"\x00\xff", "2.bin": b"2", "3.bin": b"3\n"}
        assert os.path.getsize(f"{root.removeprefix('file://').removeprefix('file:')}/x/none.bin") == 0
    assert io.write_files(files.limit(0), f"{tmp_path}/plain") == 0


def test_the_driver_lists_no_files(spark, tmp_path, monkeypatch):
    """Tasks list the folders: what the driver holds does not grow with the files."""
    rows = [(f"{i % 3}/{'deep/' * (i % 2)}{i}.bin", bytes([i]) * (i + 1)) for i in range(40)] + [("0/_part.bin", b"no"), (".x/41.bin", b"no"), ("1/z.txt", b"no")]
    files = spark.createDataFrame(rows, "path string, content binary")
    io.write_files(files, str(tmp_path / "all"))
    for name, value in (("TASK_FILES", 7), ("BATCH_BYTES", 50), ("BATCH_ROWS", 4)):
        monkeypatch.setattr(io, name, value, raising=False)
    found = io.read_files(spark, str(tmp_path / "all"), "*.bin", max_bytes=30)
    assert found.inputFiles() == [] or not any(n.endswith(".bin") for n in found.inputFiles())
    got = {r.path: (r.length, None if r.content is None else bytes(r.content)) for r in found.collect()}
    assert got == {f"file:{tmp_path}/all/{p}": (len(c), c if len(c) <= 30 else None) for p, c in rows[:40]}
    listed = io.list_files(spark, f"file://{tmp_path}/all/0")
    assert listed.count() == 14 and listed.where("modified_at > current_timestamp() - INTERVAL 1 HOUR").count() == 14
    assert [r.length for r in io.list_files(spark, f"{tmp_path}/all/1/z.txt").collect()] == [2]


def test_names_that_look_packed_keep_their_bytes(spark, tmp_path):
    io.write_files(spark.createDataFrame([("a b/1.gz", b"plain"), ("2.bz2", b"too")], "path string, content binary"), str(tmp_path))
    assert {bytes(r.content) for r in io.read_files(spark, str(tmp_path)).collect()} == {b"plain", b"too"}
