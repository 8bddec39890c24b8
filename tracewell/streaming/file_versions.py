"""An extension beyond batch comparison: changes of files from a stream of their versions.

Each micro-batch of (path, identity, version) is compared with the latest state and appended as changes; the state is a table with one folder for
each batch, so a batch that is run again writes the same folder again and nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SHAPE = "path string, identity string, version long"


def latest(rows: DataFrame) -> DataFrame:
    """The newest version of each path; a null identity is a file that is gone."""
    place = Window.partitionBy("path").orderBy(F.desc("version"), "identity")
    return rows.withColumn("n", F.row_number().over(place)).where("n = 1").drop("n")


def state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    rows = spark.read.schema(SHAPE + ", status string, batch long").option("recursiveFileLookup", "false").parquet(f"{folder}/changes") if _there(spark, f"{folder}/changes") else spark.createDataFrame([], SHAPE + ", status string, batch long")
    return rows if before is None else rows.where(F.col("batch") < before)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def apply_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    spark = batch.sparkSession
    new = latest(batch.select("path", "identity", "version"))
    old = latest(state(spark, folder, batch_id).select("path", "identity", "version")).select("path", F.col("identity").alias("was"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("identity").isNull(), "deleted").otherwise("modified")
    changes = new.join(old, "path", "left").where(~F.col("identity").eqNullSafe(F.col("was"))).select("path", "identity", "version", status.alias("status"))
    changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")


def follow(versions: DataFrame, folder: str) -> StreamingQuery:
    """Starts following a stream of versions until it has taken all there is."""
    return versions.writeStream.foreachBatch(lambda df, i: apply_batch(df, i, folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
