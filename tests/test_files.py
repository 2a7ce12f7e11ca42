"""Scans of odd files, and expressions on odd values."""

from pyspark.sql import functions as F

from gravelbed.functions import binary, text
from gravelbed.operators import records
from gravelbed.sources import files


def test_logs_without_headers_keys_or_times(spark, tmp_path):
    folder = tmp_path / "comp_x" / "map_m" / "wg_64"
    folder.mkdir(parents=True)
    (folder / "a.log").write_text("noise\n# SAMPLE=s R=2\n[COMP ] orig=10 comp=5 kernel=oops ms\n[DECOMP] kernel=1.5 ms\n# WG=32 R=x\nnothing\n# R=3\n[COMP ] kernel=2 ms\n[COMP ] kernel=9 ms\n")
    (folder / "empty.log").write_text("")
    (folder / "b.txt").write_text("# R=1\n[COMP ] kernel=1 ms\n")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "c.log").write_text("# R=1\n[COMP ] kernel=1 ms\n")
    got = sorted((tuple(r)[1:] for r in files.run_logs(spark, str(tmp_path)).collect()), key=str)
    assert got == [("x", "m", "64", "s", 2, None, 1.5, 10.0, 5.0), ("x", "m", "64", None, 3, 2.0, None, None, None)]
    assert sorted((r["tag"], r["value"]) for r in files.profiles(spark, str(tmp_path), "comp", "kernel").collect()) == [("COMP", 2.0), ("COMP", 9.0), ("DECOMP", 1.5)]


def test_table_lines_and_csv_faults(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("m1| f 100 1 50 50.0 1.0 2.0 |\nm1| g 100 1 50 60.0 1 2 |\nnot a line\n")
    assert [(r["file"], r["consistent"]) for r in files.table_lines(spark, str(tmp_path / "t")).collect()] == [("f", True), ("g", False)]
    (tmp_path / "c.csv").write_text("b,a\nx,1\n,oops\n")
    assert [tuple(r) for r in files.csv_table(spark, str(tmp_path / "c.csv"), {"a": "int", "b": "string", "c": "double"}).collect()] == [(1, "x", None), (None, None, None)]


def test_expressions(spark):
    row = spark.range(1).select(
        text.byte_size(F.lit("16k")).alias("a"), text.byte_size(F.lit("2 GB")).alias("b"), text.byte_size(F.lit("k")).alias("c"), text.plain_name(F.lit("x.pk"), ".pk").alias("d"), text.plain_name(F.lit(".pk"), ".pk").alias("e"),
        *(text.percent_text(F.lit(v)).alias(f"p{i}") for i, v in enumerate((-1.0, 5.26, 99.9375, 99.99, 123.4, 5e6))), files.last_match(F.lit("k=1 k=22"), r"k=(\d+)").alias("f"), files.last_match(F.lit(""), r"k=(\d+)").alias("g"),
        binary.first_mismatch(F.lit(b"abc"), F.lit(b"abc")).alias("h"), binary.first_mismatch(F.lit(b"abc"), F.lit(b"abcd")).alias("i"), binary.first_mismatch(F.lit(b"abc"), F.lit(None).cast("binary")).alias("j"),
    ).first()
    assert tuple(row) == (16 << 10, 2 << 30, None, "x", ".pk.raw", "0.0", " 5.3", "99.9", "100", "123", "9999", "22", None, None, 3, 0)


def test_nearest_rank_over_many_ranges(spark):
    rows = spark.range(2001).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3).alias("k"), F.when(F.col("id") % 11 > 0, (F.col("id") * 7 % 501).cast("double")).alias("v"))
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in records.nearest_rank(rows, ["k"], "v", {"a": 0.0, "b": 0.5, "c": 1.0}).collect()}
    for k in (None, 1, 2):
        v = sorted(float(i * 7 % 501) for i in range(2001) if (i % 3 or None) == k and i % 11)
        assert got[k] == (v[0], v[len(v) // 2], v[-1])
