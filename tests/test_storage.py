import time

from tracewell import storage


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_of_a_step_go_with_it(spark):
    """Steps don't add up on disk: what a step dealt is gone once it is written."""
    before, kept = shuffle_files(spark), spark.conf.get(storage.CLEANUP, None)
    rows = storage.materialize(spark.range(10_000).repartition(3, "id").groupBy("id").count(), "cleaned")
    end = time.time() + 10
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(storage.CLEANUP, None) == kept and rows.count() == 10_000
