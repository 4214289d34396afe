"""Sinks of streams: rows appended in order, the current row of each key in bucketed files under a manifest, and short texts."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

BUCKETS = 64
#: Manifests that stay after a newer one, for readers that hold an older.
KEPT_MANIFESTS = 3


def appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every row once, as Parquet by day of receipt; a restart goes on where the checkpoint ends."""
    rows = stream.withColumn("received_day", F.to_date(F.current_timestamp()))
    return rows.writeStream.format("parquet").partitionBy("received_day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Folder:
    """A folder in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.root = path.rstrip("/")
        self.fs = self.at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def put(self, name: str, text: str) -> None:
        """Writes a small file under another name and renames it, so it is there whole or not at all."""
        draft = self.at(f".{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if not self.fs.rename(draft, self.at(name)):  # another run of the same batch was first
            self.fs.delete(draft, False)

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class Upserts:
    """The current row of each key, in a fixed number of buckets by the key's hash.

    A manifest names each bucket's folder; the newest one is the table. A batch reads and rewrites only the buckets that
    its keys fall into, writes their folders under a name of its own, and then its manifest, so a run that dies in between
    leaves the table as it was and a batch that comes again changes nothing. Folders that no kept manifest names are
    deleted.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets, self.folder = spark, buckets, Folder(spark, path)

    def manifest(self, before: int | None = None) -> dict:
        """The newest manifest, or the newest of the batches before one."""
        found = [n for n in self.folder.names() if n.startswith("manifest-")]
        found = [n for n in found if before is None or int(n.removeprefix("manifest-")) < before]
        return json.loads(self.folder.text(found[-1])) if found else {"batch": -1, "buckets": {}, "schema": None, "count": self.buckets}

    def merge(self, batch: DataFrame, number: int, key: str, order: list[str]) -> dict:
        """The manifest after a batch: of each key the row that is last in order stays, of equal ones the batch's."""
        now = self.manifest()
        if now["batch"] >= number:
            return now
        if now["count"] != self.buckets:
            raise ValueError(f"the table has {now['count']} buckets, not {self.buckets}")
        rest = [c for c in batch.columns if c != key]
        bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")
        last = lambda rows: rows.groupBy(key).agg(F.max_by(F.struct(*rest, "_new"), F.struct(*order, "_new")).alias("row")).select(key, "row.*")
        fresh = last(batch.withColumn("_new", F.lit(1))).withColumn("_bucket", bucket)
        touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())
        if touched:
            old = [now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]]
            parts = [self.spark.read.schema(batch.schema).parquet(f"{self.folder.root}/{name}").withColumn("_new", F.lit(0)) for name in old]
            both = reduce(DataFrame.unionByName, parts, fresh.drop("_bucket"))
            home = f"data-{number:010d}-{uuid.uuid4().hex[:8]}"
            merged = last(both).select(*batch.columns, bucket.alias("_bucket")).repartition(len(touched), "_bucket")
            merged.write.partitionBy("_bucket").parquet(f"{self.folder.root}/{home}")
            now["buckets"] |= {str(b): f"{home}/_bucket={b}" for b in touched}
        now |= {"batch": number, "schema": batch.schema.json()}
        self.folder.put(f"manifest-{number:010d}", json.dumps(now))
        self.clean()
        return now

    def clean(self) -> None:
        """Deletes old manifests, and the bucket folders that no kept one names."""
        manifests = [n for n in self.folder.names() if n.startswith("manifest-")]
        for n in manifests[:-KEPT_MANIFESTS]:
            self.folder.drop(n)
        kept = {x for n in manifests[-KEPT_MANIFESTS:] for x in json.loads(self.folder.text(n))["buckets"].values()}
        newest = int(manifests[-1].removeprefix("manifest-")) if manifests else -1
        for home in [n for n in self.folder.names() if n.startswith("data-")]:
            named = [x for x in kept if x.startswith(f"{home}/")]
            if not named and int(home.split("-")[1]) <= newest:
                self.folder.drop(home)
            elif named:
                for part in [n for n in self.folder.names(home) if n.startswith("_bucket=") and f"{home}/{n}" not in kept]:
                    self.folder.drop(f"{home}/{part}")

    def table(self) -> DataFrame | None:
        """The current rows; None before the first batch."""
        now = self.manifest()
        if not now["buckets"]:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(*[f"{self.folder.root}/{x}" for x in now["buckets"].values()])


def upserted(stream: DataFrame, key: str, order: list[str], path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """The last row of each key, kept by `Upserts`; readers take `current`."""

    def merge(batch: DataFrame, number: int) -> None:
        Upserts(batch.sparkSession, path, buckets).merge(batch, number, key, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The current rows of an upserted table; None before the first."""
    return Upserts(spark, path).table()


def as_text(rows: DataFrame, path: str, kind: str = "csv", most: int = 100_000) -> None:
    """A short result as one CSV file, or as lines of a Markdown table; more than most rows raise."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    if kind == "csv":
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    lines = [f"| {' | '.join(rows.columns)} |", f"|{'-|' * len(rows.columns)}", *[r[0] for r in rows.select(F.concat(F.lit("| "), cells, F.lit(" |"))).collect()]]
    rows.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
