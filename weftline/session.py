"""Session settings and the folder for written intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def build_session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; anything passed in ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables: ``spark.checkpoint.dir`` if the cluster names one.

    Only where the setting is absent and all runs on one machine (tests, a laptop) a temporary folder of this machine is used; a
    cluster without the setting is refused, as its executors would not find each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="weftline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Spark's setting (4.1 or later; unknown to others, which ignore it) to remove a query's shuffle files when the query has ended.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that several readers don't repeat the work.

    Its shuffle files are removed as soon as it is kept. Spark would hold them until the driver collects garbage, and a job of many
    rounds fills the executors' disks before that.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        own = df.select("*")  # a plan takes the setting over when it is made
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)
    return own.checkpoint(eager=True)


class Kept:
    """Tables written once into a folder of their own under the shared one, to be read many times and dropped when they are done with.

    Parquet keeps them small where a checkpoint would write whole rows; a table that is dropped frees its disk at once.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str, Observation]] = []

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` as written; its rows are counted on the way."""
        path, seen = f"{self.folder}/{len(self.tables)}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        self.tables.append((self.spark.read.schema(df.schema).parquet(path), path, seen))
        return self.tables[-1][0]

    def rows(self, df: DataFrame) -> int:
        """How many rows a table had when it was written, without reading it. Work that was done again after a loss may count twice."""
        return next(seen for t, _, seen in self.tables if t is df).get.get("rows", 0)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that are not read any more; lazy ones that are made from them must have been written before."""
        for path in [p for t, p, _ in self.tables if any(t is x for x in tables)]:
            delete(self.spark, path)

    def drop_all(self) -> None:
        delete(self.spark, self.folder)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, in whatever store its path names; nothing happens if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
