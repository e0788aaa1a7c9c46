"""Helpers shared by the training-data operators."""
from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Anything but these is part of a word, after A-Z has been lower-cased.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space: the gap between tokens.
SPACE_GAP = r"[\x20\x09-\x0D]+"
#: Bytes, in compressed files, up to which a table is broadcast.
BROADCAST_BYTES = 24_000_000


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts that are all ASCII take the built-in fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def split_words(c: Column, gap: str) -> Column:
    """The non-empty pieces of c between gaps; an empty array for null and for a text without words.

    Only the first and the last piece of a split can be empty, so both are cut off by position.
    """
    parts = F.split(F.coalesce(c, F.lit("")), gap)
    return F.filter(parts, lambda x: x != "")


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; where none is set, a temporary one, in local mode only."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="nestflow-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Tables written to the shared folder: they cut lineage and outlive any executor.

    ``keep(df)`` writes df as Parquet and reads it back; ``drop(df)`` deletes such a table once nothing reads it.
    What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}
        atexit.register(self.close)

    def path(self) -> str:
        return f"{self.root}/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        path = self.path()
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def is_small(self, df: DataFrame) -> bool:
        """Whether a kept table's files hold ``BROADCAST_BYTES`` at most."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths[id(df)][0])
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return files.getContentSummary(path).getLength() <= BROADCAST_BYTES

    def small(self, df: DataFrame) -> DataFrame:
        """A kept table with a hint to broadcast it if it is small; else as it is, for a shuffled join."""
        return F.broadcast(df) if self.is_small(df) else df

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                _delete(self.spark, path)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.root)
        except Exception:  # the session may have gone first; the folder is a scratch folder
            pass


def text_batches(spark: SparkSession, n: int = 2000) -> None:
    """Lowers the session's Arrow batches from their default of 10,000 rows, too many where rows are whole texts; a caller's own value stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(n))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, n: int):
    """Arrow batches of at most n rows for what runs inside; rows that hold whole sets or blocks are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(old)) if int(old) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, old)


#: Bits by which keys are told to be surely absent: 64 in each of 2^18 rows.
SLOTS = 1 << 18


def split_by_keys(df: DataFrame, hash_col: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may be among those of keys, rows whose hash surely is not); keys has the column ``h``.

    A table of bits, ``SLOTS`` rows at most however many keys there are, is broadcast; so only rows that a join with the keys can concern need be shuffled for it.
    """
    bit = lambda h: F.expr(f"shiftleft(1L, cast(pmod(shiftright({h}, 18), 64) as int))")
    bits = keys.groupBy(F.pmod(F.col("h"), F.lit(SLOTS)).alias("__slot")).agg(F.bit_or(bit("h")).alias("__bits"))
    at = df.join(F.broadcast(bits), F.pmod(F.col(hash_col), F.lit(SLOTS)) == bits["__slot"], "left")
    there = F.coalesce(bits["__bits"].bitwiseAND(bit(f"`{hash_col}`")) != 0, F.lit(False))
    own = [df[c] for c in df.columns]
    return at.where(there).select(*own), at.where(~there).select(*own)


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality on all pairs of columns, nulls equal to nulls."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond
