"""Tables between the passes of a job, in the folder that the driver and all executors share."""
from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession

from .sources.tables import scratch

#: Bytes that a byte of a kept table's files may be as rows: sorted numbers and repeated names take next to nothing in a file.
UNPACKED = 50


def rows_not_files(spark: SparkSession) -> None:
    """Has Spark plan joins by what files hold as rows. Else it broadcasts, through the driver, whatever is small in files; adaptive execution still broadcasts what it sees to be small. A caller's own factor stays."""
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) == 1:
        spark.conf.set(key, str(float(UNPACKED)))


class Stages:
    """Tables written as Parquet and read again.

    What is read again has no plan behind it: lineage ends there, so does what the optimizer thinks of its size, and the table outlives any executor. ``drop`` deletes tables that nothing reads any more; what is left
    goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        rows_not_files(spark)
        self.spark, self.root, self.made = spark, scratch(spark, name), 0
        self.paths: dict[int, tuple[str, DataFrame]] = {}
        atexit.register(self.close)

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                self._delete(path)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the session may have gone first; the folder is a scratch folder
            pass

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
