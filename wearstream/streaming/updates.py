"""Live updates: after each trigger the new points and a snapshot of every worker that it touched, for the worker and the admins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Admins that may follow all workers; more raise, as each of them gets every point.
MOST_ADMINS = 1000


def points(decided: DataFrame) -> DataFrame:
    """Trend points of `live.states` rows: the confirmed state of a row that counts, else UNCERTAIN with its reason."""
    counts = F.col("smoothed").isNotNull()
    return decided.select(
        "worker", "seq", "us", F.when(counts, F.col("smoothed")).otherwise("UNCERTAIN").alias("state"), F.col("state").alias("system_state"),
        F.when(counts, F.col("confidence")).alias("confidence"), F.when(~counts, F.col("reason")).alias("reason"),
    )


def snapshots(decided: DataFrame) -> DataFrame:
    """The last row of each worker, with how many points came with it."""
    row = F.struct("us", "state", "smoothed", "confirmed", "confidence", "reason", "session")
    return decided.groupBy("worker").agg(F.max("seq").alias("seq"), F.max_by(row, "seq").alias("latest"), F.count("*").alias("points")).select("worker", "seq", "latest.*", "points")


def addressed(rows: DataFrame, followers: DataFrame) -> DataFrame:
    """rows (with worker) for each recipient: the worker (followers: recipient, role, worker), and every admin.

    Workers get only their own rows. Raises if there are more than MOST_ADMINS admins.
    """
    admins = followers.where("role = 'admin'").select("recipient").distinct()
    if admins.limit(MOST_ADMINS + 1).count() > MOST_ADMINS:
        raise ValueError(f"more than {MOST_ADMINS} admins")
    own = followers.where("role = 'worker'").select("recipient", F.col("worker").alias("_w")).distinct()
    mine = rows.join(own, F.col("worker") == F.col("_w")).drop("_w")
    return mine.unionByName(rows.crossJoin(F.broadcast(admins)))


def published(decided: DataFrame, followers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each trigger's points and snapshots for their recipients below path, by batch number.

    A batch that comes again replaces what it wrote, so it adds nothing. Recipients read points/ and snapshots/; an
    update is a hint on top of the stored rows, which hold everything.
    """

    def put(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for name, rows in (("points", points(kept)), ("snapshots", snapshots(kept))):
            addressed(rows, followers).write.mode("overwrite").partitionBy("recipient").parquet(f"{path}/{name}/batch={number}")
        kept.unpersist()

    return decided.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def received(spark, path: str, recipient: str, name: str = "points") -> DataFrame:
    """What a recipient has got so far, with the batch that each row came in."""
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").where(F.col("recipient").cast("string") == recipient)
