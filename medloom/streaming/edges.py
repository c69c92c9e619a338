"""New edge files as they arrive: each micro-batch is merged into the edge table by an upsert, into a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from medloom.operators.merge import upsert


def _latest(spark: SparkSession, folder: str, batch: int, schema: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={batch - 1}") if batch else spark.createDataFrame([], schema)


def follow_edges(
    spark: SparkSession, incoming: str, folder: str, schema: str, keys: list[str], checkpoint: str, order: str | None = None
) -> StreamingQuery:
    """Reads edge files (Parquet) as a stream and keeps `folder`/version=N, one for each batch; new values win unless null.

    Of several rows of a batch for an edge the last one by `order` counts, as a whole (of equal ones, or without an order,
    the greatest), so no edge mixes values of different rows of a batch. A batch that is run again after a failure overwrites its own version only, so results do not depend on retries.
    """
    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        last = F.max_by(F.struct(*rest), F.struct(*([order] if order else []), *rest)).alias("row")
        new = batch.groupBy(*keys).agg(last).select(*keys, "row.*")
        upsert(_latest(session, folder, number, schema), new, keys).write.mode("overwrite").parquet(f"{folder}/version={number}")

    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
