"""CSV of any size of file, read by splits, and tables that are published by a manifest.

A line break inside quotes does not end a record, so whether a line begins one depends on all quotes of the file before it. Of each split only the number of its quotes, and then of its records, is gathered;
sums over the splits before give each line its parity and its record. No file is read as a whole, and only lines of records that span several are brought together.

A manifest lists the folders that a table is made of. Rows are staged in a folder of their own and count once a manifest with a new number lists it; a manifest appears by one rename and is never changed. What a
run that was stopped has staged is read by nobody, so the next run gives what one clean run would.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (from 0), text of each RFC 4180 record below path; a file whose quotes do not match ends in a record that holds the rest. Blank lines between records count as records."""
    t = spark.read.option("lineSep", "\n").text(path)
    t = t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    t = t.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    per = Window.partitionBy("file").orderBy("split")  # a row for each split
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = t.groupBy("file", "split").agg(F.sum("quotes").alias("n")).select("file", "split", (F.sum("n").over(per) - F.col("n")).alias("before"))
    t = t.withColumn("seen", F.coalesce(F.sum("quotes").over(inside), F.lit(0))).join(splits, ["file", "split"])
    t = t.withColumn("begins", ((F.col("before") + F.col("seen")) % 2 == 0).cast("long"))
    starts = t.groupBy("file", "split").agg(F.sum("begins").alias("n")).select("file", "split", (F.sum("n").over(per) - F.col("n")).alias("first"))
    upto = F.coalesce(F.sum("begins").over(inside), F.lit(0)) + F.col("begins")
    t = t.withColumn("upto", upto).join(starts, ["file", "split"]).withColumn("record", F.col("first") + F.col("upto") - 1)
    whole = (F.col("begins") == 1) & (F.col("quotes") % 2 == 0)
    one = t.where(whole).select("file", "record", F.col("value").alias("text"))
    lines = F.sort_array(F.collect_list(F.struct("split", "at", "value")))  # of one record
    many = t.where(~whole).groupBy("file", "record").agg(F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias("text"))
    return one.unionByName(many).withColumn("text", F.regexp_replace("text", r"\r$", ""))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of CSV files with a header of exactly these columns. A record of another width or type, unmatched quotes and another header fail the job, with file and record number."""
    names = ",".join(schema.fieldNames())
    bad = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "multiLine": "true", "maxCharsPerColumn": "-1"}
    r = csv_records(spark, path)
    where = F.concat(F.col("file"), F.lit(", record "), F.col("record").cast("string"), F.lit(": "))
    fail = lambda why: F.raise_error(F.concat(where, F.lit(why))).cast("boolean")
    header = F.when(F.regexp_replace("text", '"', "") == names, F.lit(False)).otherwise(fail("columns differ"))
    ok = F.when(F.col("record") == 0, header).otherwise(F.lit(True))
    r = r.where(ok & (F.col("text") != "")).withColumn("x", F.from_csv("text", F.lit(bad.simpleString()), options))
    odd = (F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))) % 2 == 1
    good = F.when(F.col("x").isNull() | F.col("x.__bad").isNotNull() | odd, fail("not a row")).otherwise(F.lit(True))
    return r.where(good).select(*[F.col("x").getField(c).alias(c) for c in schema.fieldNames()])


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, p = _files(spark, f"{root}/manifests")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []


def manifest(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders that the table at root is made of; none before the first publication."""
    if not (n := _numbers(spark, root)):
        return []
    return json.loads(spark.read.text(f"{root}/manifests/{n[-1]}", wholetext=True).first()[0])["folders"]


def stage(df: DataFrame, root: str) -> str:
    """Writes df as Parquet to a folder of its own below root, which nobody reads until it is published; gives its name."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{root}/data/{name}")
    return name


def publish(spark: SparkSession, root: str, folders: list[str], number: int | None = None) -> int:
    """Makes these folders the table by a manifest of the next number, or of this one; an error if another run has published that number first."""
    number = (_numbers(spark, root) or [0])[-1] + 1 if number is None else number
    fs, tmp = _files(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.write(bytearray(json.dumps({"folders": folders}, sort_keys=True).encode()))
    out.close()
    _, end = _files(spark, f"{root}/manifests/{number}")
    if fs.exists(end) or not fs.rename(tmp, end):
        fs.delete(tmp, False)
        raise RuntimeError(f"{root}: manifest {number} is there already")
    return number


def read(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The published rows."""
    folders = [f"{root}/data/{f}" for f in manifest(spark, root)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append(df: DataFrame, root: str, *keys: str) -> int:
    """Publishes beside what is there those rows of df whose keys are not, one row a key; gives their number. A run that dies before its manifest appears has done nothing."""
    spark = df.sparkSession
    known = _numbers(spark, root)
    have = manifest(spark, root)
    new = df.dropDuplicates(list(keys)).join(read(spark, root, df.schema).select(*keys), list(keys), "left_anti").select(*df.columns)
    folder = stage(new, root)
    n = spark.read.schema(df.schema).parquet(f"{root}/data/{folder}").count()
    publish(spark, root, [*have, folder], (known or [0])[-1] + 1)
    return n


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Deletes staged folders that no manifest lists, and gives their names; call it while no run is at work."""
    fs, p = _files(spark, f"{root}/data")
    keep = {f for n in _numbers(spark, root) for f in json.loads(spark.read.text(f"{root}/manifests/{n}", wholetext=True).first()[0])["folders"]}
    gone = [f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName() not in keep] if fs.exists(p) else []
    for name in gone:
        fs.delete(_files(spark, f"{root}/data/{name}")[1], True)
    return gone
