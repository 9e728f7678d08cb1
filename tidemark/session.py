"""Sessions, and tables that cut lineage.

Iterative operators write each round to a Parquet table below the folder that the
session names in ``spark.checkpoint.dir``, which all executors share. Unlike cached
blocks such a table outlives any executor, and unlike RDD checkpoints it is
columnar, so that a later round reads only the columns it uses.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: list[str] = []


def build_session(app: str = "tidemark", master: str = "local[8]", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for written rounds: the cluster's, or in local mode a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _own_dirs[0], ignore_errors=True)
    return f"file://{_own_dirs[0]}"


class Scratch:
    """Written tables of one operator run.

    ``save`` writes a DataFrame and returns it read back, without lineage;
    ``drop`` deletes tables no longer needed; ``finish`` writes the result and
    deletes every other table of the run.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.written = 0
        self.tables: list[tuple[DataFrame, str]] = []
        self.named: dict[str, str] = {}

    def save(self, df: DataFrame, tag: str = "t", by: tuple[str, ...] = ()) -> DataFrame:
        """Write and read back; ``by`` names columns to partition the table by."""
        self.written += 1
        path = f"{self.root}/{self.written:04d}-{tag}"
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def bucketed(self, df: DataFrame, columns: tuple[str, ...], buckets: int, tag: str = "b") -> DataFrame:
        """Write in buckets by the hash of some columns, one file each: joins on these read the table without a shuffle."""
        self.written += 1
        path, name = f"{self.root}/{self.written:04d}-{tag}", f"scratch_{uuid.uuid4().hex}"
        df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).sortBy(*columns).option("path", path).saveAsTable(name)
        table = self.spark.table(name)
        self.tables.append((table, path))
        self.named[path] = name
        return table

    def drop(self, *gone: DataFrame) -> None:
        for table, path in self.tables:
            if any(table is x for x in gone):
                self._delete(path)
        self.tables = [(t, p) for t, p in self.tables if not any(t is x for x in gone)]

    def held(self) -> list[DataFrame]:
        """The tables not yet dropped."""
        return [table for table, _ in self.tables]

    def keep(self, *wanted: DataFrame) -> None:
        """Drop every other table."""
        self.drop(*(t for t, _ in self.tables if not any(t is x for x in wanted)))

    def finish(self, df: DataFrame, tag: str = "result") -> DataFrame:
        result = self.save(df, tag)
        self.keep(result)
        return result

    def remove(self, path: str) -> None:
        """Delete a folder that is no table of this run."""
        self._delete(path)

    def _delete(self, path: str) -> None:
        if path in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.named.pop(path)}")
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
