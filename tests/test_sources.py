
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from linetriage import session
from linetriage.sources import inventory, profile, readers, sinks


def test_segments_come_from_file_names(spark, tmp_path):
    for name in ("left", "right"):
        (tmp_path / f"set_labeled_{name}.csv").write_text("row_id,label,f\n1,0,0.5\n2,1,1.5\n")
    rows = readers.read_segments(spark, f"{tmp_path}/set_labeled_*.csv", ["f"], True, r"set_labeled_([^/.]+)\.csv")
    assert sorted((r.segment, r.row_id, r.label) for r in rows.collect()) == [
        ("left", 1, 0), ("left", 2, 1), ("right", 1, 0), ("right", 2, 1)]
    (tmp_path / "set_labeled_bad.csv").write_text("row_id,label,other\n1,0,0.5\n")
    with pytest.raises(Exception):
        readers.read_segments(spark, f"{tmp_path}/set_labeled_*.csv", ["f"], True, r"labeled_([^/.]+)\.csv").collect()


def test_text_keeps_blanks_and_line_order(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,v\n" + "".join(f"{i},{'' if i % 2 else ' x'}\n" for i in range(50)))
    rows = readers.read_text_columns(spark, str(path), ["id", "v"], lines=True).orderBy("line").collect()
    assert [r.id for r in rows] == [str(i) for i in range(50)] and [r.line for r in rows] == list(range(1, 51))
    assert rows[1].v == "" and rows[0].v == " x"


def test_declared_encoding(spark, tmp_path):
    path = tmp_path / "k.csv"
    path.write_bytes("이름;값\n금형;1\n".encode("cp949"))
    assert readers.read_declared(spark, str(path), "cp949", ";").first()["이름"] == "금형"
    bom = tmp_path / "b.csv"
    bom.write_bytes("a,b\n1,2\n".encode("utf-8-sig"))
    assert readers.read_declared(spark, str(bom), "utf-8-sig").columns == ["a", "b"]
    with pytest.raises(ValueError):
        readers.read_declared(spark, str(path), "latin-9")


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "l.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    assert sorted(r.x for r in readers.read_json_records(spark, str(tmp_path / "a.json"), lines=False).collect()) == [1, 2]
    assert sorted(r.x for r in readers.read_json_records(spark, str(tmp_path / "l.jsonl")).collect()) == [1, 2]


def test_sample_reports_repeated_headers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b,a\n1,2,3\n4,5,6\n")
    frame, facts = readers.read_sample(spark, str(tmp_path / "d.csv"), "csv", 1)
    assert frame.count() == 1 and facts == {"columns": 3, "repeated": ["a"]}


def test_writers_do_not_overwrite(spark, tmp_path):
    rows = spark.range(3)
    sinks.save(rows, str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.save(rows, str(tmp_path / "x"))
    sinks.save(rows, str(tmp_path / "x"), overwrite=True)


def test_row_level_columns_are_not_exported(spark):
    table = spark.createDataFrame([(1, 0.1, 2)], "seed int, fraction double, row_id int")
    with pytest.raises(ValueError, match="row_id"):
        sinks.export_aggregates(table, ["seed", "fraction"])
    assert sinks.export_aggregates(table.drop("row_id"), ["seed", "fraction"], 0.2).count() == 0


def test_changed_files_are_found(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1")
    (tmp_path / "b.txt").write_text("2")
    found = inventory.file_digests(spark, f"{tmp_path}/*.txt")
    manifest = found.where("name = 'a.txt'").withColumn("sha256", F.lit("0")).unionByName(
        found.where("name = 'b.txt'").withColumn("name", F.lit("c.txt")))
    got = {r.name: r.state for r in inventory.against_manifest(found, manifest).collect()}
    assert got == {"a.txt": "changed", "b.txt": "unexpected", "c.txt": "missing"}


def test_a_folder_is_one_entry_of_a_glob(spark, tmp_path):
    (tmp_path / "a.parquet").write_text("1")
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/b.parquet")
    spark.range(9).withColumn("k", F.col("id") % 2).write.partitionBy("k").parquet(f"{tmp_path}/c.parquet")
    found = inventory.file_digests(spark, f"{tmp_path}/*.parquet")
    first = {r.name: (r.bytes, r.sha256) for r in found.collect()}
    assert list(sorted(first)) == ["a.parquet", "b.parquet", "c.parquet"]
    assert first["a.parquet"] == (1, hashlib.sha256(b"1").hexdigest())
    parts = sorted((tmp_path / "b.parquet").glob("*.parquet"))
    assert first["b.parquet"][0] == sum(p.stat().st_size for p in parts)
    parts[0].write_bytes(parts[0].read_bytes()[:-1] + b"?")
    (tmp_path / "b.parquet" / f".{parts[0].name}.crc").unlink()  # the file was changed past its writer
    again = {r.name: (r.bytes, r.sha256) for r in inventory.file_digests(spark, f"file://{tmp_path}/*.parquet").collect()}
    assert {n for n in first if again[n] != first[n]} == {"b.parquet"}


def test_files_of_many_splits_keep_their_digest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inventory, "WHOLE", 1000)
    noise = random.Random(3)
    contents = {
        "noise": noise.randbytes(300_000), "feeds": b"\n" * 70_001, "line": b"x" * 90_000, "crlf": b"a\r\nb\r" * 9_000,
        "ended": noise.randbytes(50_000) + b"\n", "mark": b"\xef\xbb\xbf" + noise.randbytes(40_000), "mark ended": b"\xef\xbb\xbf" + b"y\n" * 5_000,
        "zeros": bytes(150_000), "edge": (b"z" * 9_999 + b"\n") * 8, "odd [1]*%41+": b"q\n" * 3_000, "few": b"1\n", "a.gz": gzip.compress(noise.randbytes(5_000))}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = {r.name: (r.bytes, r.sha256) for r in inventory.file_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}


def test_checksum_ignores_row_order(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    a = profile.checksum(rows, ["id", "v"]).first()
    assert a == profile.checksum(rows.repartition(9).orderBy(F.desc("v")), ["id", "v"]).first()
    assert a != profile.checksum(rows.withColumn("v", F.col("v") + (F.col("id") == 3).cast("int")), ["id", "v"]).first()
    assert profile.fast_checksum(rows, ["id"]).first() == profile.fast_checksum(rows.repartition(3), ["id"]).first()


def test_profile_counts_whole_table(spark):
    rows = spark.range(100).select(F.when(F.col("id") % 4 != 0, F.col("id") % 5).alias("x"))
    r = profile.profile(rows).first()
    assert (r["rows"], r["nulls"], r["distinct_values"]) == (100, 25, 5)
    assert profile.profile(rows, exact=False).first()["nulls"] == 25


def test_the_shared_folder_is_the_configured_one(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert sinks.scratch_folder(spark).startswith(root) and session.shared_root(spark) == root
    assert session.cut_lineage(spark.range(3)).count() == 3
    assert root in spark.sparkContext.getCheckpointDir()
