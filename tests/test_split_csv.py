"""CSV with line breaks, read in small splits, against the one-task reader."""

import random

from stockloom.sources import files, split_csv

SCHEMA = "id bigint, t string, a array<string>, n int, s struct<x: int, y: string>"


def _parts(rng):
    texts = ["", "plain", 'say "hi"', "two\nlines", "\n", 'a,"b"\n"c",d', "é\r\nend", "x" * 50, "\n\n\n", '""', None, " pad "]
    return [(i, rng.choice(texts), rng.choice([None, [], ["a", "b,c", 'q"t']]), rng.choice([None, 5]), rng.choice([None, (1, "z\n")])) for i in range(300)]


def test_splits_read_what_one_task_reads(spark, tmp_path):
    rows = _parts(random.Random(1))
    frame = spark.createDataFrame(rows, SCHEMA)
    files.write_csv(frame.coalesce(2), str(tmp_path / "t"))
    want = sorted(map(str, files.read_csv(spark, str(tmp_path / "t"), SCHEMA, multi_line=True).collect()))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        good, bad = split_csv.read_csv_split(spark, str(tmp_path / "t"), SCHEMA)
        splits = spark.read.text(str(tmp_path / "t")).selectExpr("_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert splits > 10
    assert sorted(map(str, good.collect())) == want and len(want) == 300
    assert bad.count() == 0


def test_rejects_name_place_and_reason(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(
        b'id,t,a,n,s\r\n1,"a\nb",{x},2,"{""x"":1}"\r\n\r\nx,"c",{},1,\r\n3,d,no braces,1,\r\n4,e,{},1,"{""x"""\r\n5,f\r\n6,"g\n\nh",,7,\r\n7,"open\n' + b"line\n" * 40
    )
    good, bad = split_csv.read_csv_split(spark, str(path), SCHEMA, max_lines=30)
    assert sorted((r.id, r.t, r.a, r.n) for r in good.collect()) == [(1, "a\nb", ["x"], 2), (6, "g\n\nh", None, 7)]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [(5, "bad_fields"), (6, "bad_array"), (7, "bad_json"), (8, "bad_fields"), (12, "unclosed_quote")]
    texts = {r.line: r.record for r in bad.collect()}
    assert texts[5] == 'x,"c",{},1,' and texts[12] is None


def test_only_a_header(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,t,a,n,s\n")
    good, bad = split_csv.read_csv_split(spark, str(path), SCHEMA)
    assert good.count() == 0 and bad.count() == 0 and good.columns == ["id", "t", "a", "n", "s"]
