"""Written tables leave nothing behind but themselves."""

import time

from pyspark.sql import functions as F

from oligoframe.lineage import CLEANUP, cut


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_with_the_execution(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    df = spark.range(20_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    out = cut(df)
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP, None) == setting
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
