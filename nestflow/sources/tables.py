"""Tables that pipelines leave behind: strict CSV, tagged unions, attribute tables, filtered rewrites, resumable and sorted outputs, metadata and paths."""
from __future__ import annotations

import json
import re
import tempfile
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import duplicate_keys, wrong_version


def read_csv(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None, column: str = "schema_version") -> DataFrame:
    """RFC 4180 with exactly these columns; a row of another width or type fails the job, and so does another schema version."""
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", multiLine=True, quote='"', escape='"')
    if version is not None and wrong_version(df, version, column).limit(1).count():
        raise ValueError(f"{path}: {column} is not {version} throughout")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; complete once its success marker is there. -0.0 is written as 0.0."""
    plain = [F.when(F.col(f.name) == 0, F.lit(0.0)).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields]
    df.select(*plain).write.csv(path, header=True, quote='"', escape='"', mode="overwrite")


def append_csv(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """Adds to a CSV folder those rows of df whose keys it does not hold yet, and returns them; a folder without its success marker counts as empty and is written anew.

    So a run that was stopped can be started again: what it had committed stays, and nothing is written twice.
    """
    spark = df.sparkSession
    if not complete(spark, path):
        write_csv(df, path)
        return df
    have = spark.read.csv(path, schema=df.schema, header=True, quote='"', escape='"', mode="FAILFAST", multiLine=True)
    new = df.join(have.select(*keys).distinct(), list(keys), "left_anti").select(*df.columns)
    new = new.checkpoint() if spark.sparkContext.getCheckpointDir() else new.persist()  # the folder that it is read against changes
    new.write.csv(path, header=True, quote='"', escape='"', mode="append")
    return new


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder of files holds its success marker."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def incomplete_tails(spark: SparkSession, path: str) -> DataFrame:
    """path of each text file that does not end in a newline or has an odd number of quotes: its last record was cut off."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return t.where((F.col("value") != "") & (~F.endswith("value", F.lit("\n")) | (quotes % 2 == 1))).select("path")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the driver and all executors share; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="nestflow-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def without_keys(df: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key is not among the others."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def unfinished(payload: DataFrame, committed: DataFrame, *keys: str) -> DataFrame:
    """Keys that have rows but no commit marker; a resumed run drops their rows and does them again."""
    return payload.select(*keys).distinct().join(committed.select(*keys).distinct(), list(keys), "left_anti")


def split_union(rows: DataFrame, key: tuple[str, ...] = ("g",)) -> tuple[DataFrame, DataFrame]:
    """(graphs, edges) of a table whose record_type is graph or edge."""
    g = rows.where("record_type = 'graph'").select(*key, "n", "edge_count")
    e = rows.where("record_type = 'edge'").select(*key, "u", "v", "step", "time")
    return g, e


def union_violations(rows: DataFrame, key: tuple[str, ...] = ("g",)) -> DataFrame:
    """Graphs whose edge rows are not as many as they say, and edges without a graph."""
    g, e = split_union(rows, key)
    n = e.groupBy(*key).agg(F.count("*").alias("found"))
    return g.join(n, list(key), "full").where(~F.col("edge_count").eqNullSafe(F.coalesce("found", F.lit(0)))).select(*key, "edge_count", "found")


def wide_fields(fields: DataFrame, names: list[str], key: tuple[str, ...] = ("g",)) -> DataFrame:
    """A column for each named field of (key, field_name, value)."""
    return fields.groupBy(*key).pivot("field_name", names).agg(F.first("value"))


def long_fields(wide: DataFrame, names: list[str], key: tuple[str, ...] = ("g",)) -> DataFrame:
    return wide.select(*key, F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("field_name", "value")).where("value IS NOT NULL")


def with_edges(graphs: DataFrame, atoms: DataFrame) -> DataFrame:
    """Each graph with its intervals in order of birth and death; none for an empty diagram."""
    a = atoms.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("birth", "death", "coefficient"))).alias("diagram"))
    return graphs.join(a, "g", "left").withColumn("diagram", F.coalesce("diagram", F.expr("cast(array() as array<struct<birth:double,death:double,coefficient:double>>)")))


def write_result(df: DataFrame, path: str, version: int, *keys: str) -> None:
    """Parquet in order of the keys, the schema version first; repeated keys are an error."""
    if duplicate_keys(df, *keys).limit(1).count():
        raise ValueError(f"keys {keys} repeat")
    out = df.select(F.lit(version).alias("schema_version"), *df.columns)
    out.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path, mode="overwrite")


def ranked(df: DataFrame, *keys: str) -> DataFrame:
    """With each row's place in the order of the keys, from 0."""
    from ..operators.numbering import numbered

    return numbered(df, [], list(keys), "place").withColumn("place", F.col("place") - 1)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_metadata(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON object, sorted by key, through the file systems that Spark knows: written beside the target, then renamed onto it."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    end, tmp = hadoop.Path(path), hadoop.Path(path + ".tmp")
    fs = end.getFileSystem(conf)
    out = fs.create(tmp, True)
    out.write(bytearray((json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n").encode()))
    out.close()
    fs.delete(end, False)
    fs.rename(tmp, end)


def read_metadata(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> dict:
    value = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if missing := [k for k in required if k not in value]:
        raise ValueError(f"{path} lacks {missing}")
    return value


class Layout:
    """Paths below a root: names are plain, and nothing leaves the root or overlaps."""

    def __init__(self, root: str):
        self.root, self.taken = root.rstrip("/"), {}

    def path(self, *parts: str) -> str:
        for p in parts:
            if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", p) or ".." in p:
                raise ValueError(f"name {p!r}")
        return "/".join([self.root, *parts])

    def claim(self, name: str, *parts: str) -> str:
        """A path for one table; no other table may lie within it or around it."""
        p = PurePosixPath(self.path(*parts))
        for other, q in self.taken.items():
            if other != name and (p == q or p in q.parents or q in p.parents):
                raise ValueError(f"{name} overlaps {other}")
        self.taken[name] = p
        return self.path(*parts)
