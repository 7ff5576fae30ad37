import os

from pyspark.sql import functions as F

from weftline.session import settled


def shuffle_files(spark) -> int:
    """Shuffle data files in the folders of this session's block manager."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(name.startswith("shuffle_") and name.endswith(".data") for d in folders for _, _, names in os.walk(d.getPath()) for name in names)


def test_settled_rows_stay_readable_and_leave_no_shuffle_files(spark):
    import time

    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = shuffle_files(spark)
    kept = settled(counted)
    for _ in range(100):  # files go in the background
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert kept.agg(F.sum("n")).first()[0] == 1000
    joined = settled(kept.join(counted.withColumnRenamed("n", "m"), "k"))
    assert joined.where("n = m").count() == 7


def test_settled_leaves_the_session_as_it_was(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    settled(spark.range(3))
    assert spark.conf.get(name, None) == before
