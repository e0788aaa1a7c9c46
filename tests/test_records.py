"""CSV by splits against the csv module, and tables published by manifests."""
import collections
import csv
import random

import pytest
from pyspark.sql import types as T

from nestflow.sources import records

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("note", T.StringType()), T.StructField("x", T.DoubleType())])


def written(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(SCHEMA.fieldNames())
        w.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_split_files(spark, tmp_path, end):
    """Splits of a few hundred bytes, in the middle of quoted line breaks too."""
    r = random.Random(4)
    rows = [(i, "".join(r.choice('ab ,"\n\n') for _ in range(r.randrange(60))) or "z", r.randrange(9) / 4) for i in range(400)]
    for name, part in (("a", rows[:250]), ("b", rows[250:])):
        written(tmp_path / f"{name}.csv", part, end)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        df = records.read_csv(spark, str(tmp_path), SCHEMA)
        got = collections.Counter(map(tuple, df.collect()))
        n = {x.file.split("/")[-1]: x["count"] for x in records.csv_records(spark, str(tmp_path)).groupBy("file").count().collect()}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = collections.Counter((a, b.strip() if not b.strip(" ") else b, c) for a, b, c in rows)
    assert n == {"a.csv": 251, "b.csv": 151}
    assert sum(got.values()) == 400 and {k: (b or "").strip() for k, b, _ in got} == {k: b.strip() for k, b, _ in want}


@pytest.mark.parametrize("text, why", [("k,note\n1,a\n", "columns differ"), ("k,note,x\n1,a\n", "not a row"), ("k,note,x\n1,a,b\n", "not a row"), ('k,note,x\n1,"a,2\n', "not a row"), ("k,note,x\n1,a,2,3\n", "not a row")])
def test_bad_files_fail_with_their_place(spark, tmp_path, text, why):
    (tmp_path / "t.csv").write_text(text)
    with pytest.raises(Exception, match=why) as e:
        records.read_csv(spark, str(tmp_path / "t.csv"), SCHEMA).collect()
    assert "t.csv, record" in str(e.value)


def test_published_tables(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(i, str(i), i / 2) for i in range(20)], SCHEMA)
    assert records.read(spark, root, SCHEMA).count() == 0 and records.manifest(spark, root) == []
    assert records.append(df.where("k < 5").union(df.where("k < 5")), root, "k") == 5
    real = records.publish

    def dies(*a, **b):
        raise KeyboardInterrupt

    monkeypatch.setattr(records, "publish", dies)
    with pytest.raises(KeyboardInterrupt):  # between staging and publishing
        records.append(df, root, "k")
    assert records.read(spark, root, SCHEMA).count() == 5
    monkeypatch.setattr(records, "publish", real)
    assert records.append(df, root, "k") == 15 and records.append(df, root, "k") == 0
    assert sorted(map(tuple, records.read(spark, root, SCHEMA).collect())) == sorted(map(tuple, df.collect()))
    assert len(records.sweep(spark, root)) == 1 and records.sweep(spark, root) == []
    assert records.read(spark, root, SCHEMA).count() == 20
    with pytest.raises(RuntimeError, match="there already"):  # two runs that publish the same number
        records.publish(spark, root, [], 2)
