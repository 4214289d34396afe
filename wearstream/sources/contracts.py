"""Files that must keep a contract: training tables as CSV, uploaded batches as JSON, and files known by their hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from wearstream.functions.calendar import instant
from wearstream.functions.scalars import cleaned, gps

#: The labels a training table may have, its time format, and the most samples of a batch.
LABELS = ["Safe", "Warning", "Critical"]
TIME_FORMAT = "M/d/yyyy H:mm"
MOST_SAMPLES = 600
#: Names or parts of names that no feature may have, as they give the label or the worker away.
FORBIDDEN = ["risk", "label", "target", "worker", "baseline_hr", "baseline_body", "timestamp", "prediction", "evidence", "rule", "artifact", "quality", "uncertain", "imputed", "flag"]


class ContractError(ValueError):
    """A file that doesn't keep its contract."""


def training_table(spark: SparkSession, path: str, features: list[str], *, worker: str = "worker_id", time: str = "timestamp", label: str = "risk_level", only_worker: str | None = None) -> DataFrame:
    """A CSV training table with ts (to the minute) and source_file; columns beside the contract's are left out of the scan.

    Raises if a column is missing, a label is null or unknown, or, with only_worker, another worker is in it.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in [worker, time, label, *features] if c not in header]
    if missing:
        raise ContractError(f"missing columns {missing}")
    kinds = {c: DoubleType() for c in features}
    schema = StructType([StructField(c, kinds.get(c, StringType())) for c in header])
    rows = spark.read.option("header", True).schema(schema).csv(path).select(worker, time, label, *features, F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"))
    unknown = [r[0] for r in rows.where(F.col(label).isNull() | ~F.col(label).isin(LABELS)).select(label).distinct().limit(10).collect()]
    if unknown:
        raise ContractError(f"labels {unknown} are none of {LABELS}")
    if only_worker is not None and not rows.where(F.col(worker).isNull() | (F.col(worker) != only_worker)).isEmpty():
        raise ContractError(f"rows of other workers than {only_worker}")
    return rows.withColumn("ts", F.to_timestamp_ntz(F.col(time), F.lit(TIME_FORMAT)))


def development_tables(spark: SparkSession, paths: list[str], features: list[str], held_out: str, worker: str = "worker_id", **names) -> DataFrame:
    """The union of training tables; raises if the worker kept for the last test is in any."""
    out = training_table(spark, paths[0], features, worker=worker, **names)
    for path in paths[1:]:
        out = out.unionByName(training_table(spark, path, features, worker=worker, **names))
    if not out.where(F.col(worker) == held_out).isEmpty():
        raise ContractError(f"{held_out} is kept for the last test")
    return out


def external_table(spark: SparkSession, path: str, features: list[str], certificate: dict | None, **names) -> DataFrame:
    """The last test's table; refused without the certificate of a frozen configuration."""
    from wearstream.models.training import frozen

    if not certificate or frozen(certificate) != certificate:
        raise ContractError("no frozen configuration")
    return training_table(spark, path, features, **names)


def check_features(columns: list[str], allowed: list[str]) -> None:
    """Raises for features that are forbidden or not of the contract."""
    bad = [c for c in columns if c not in allowed or any(part in c.lower() for part in FORBIDDEN)]
    if bad:
        raise ContractError(f"not features: {bad}")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file, its path below the given one, and sha256 of every file under a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/").split("://")[-1]
    below = F.when(F.locate(root + "/", "path") > 0, F.substring_index("path", root + "/", -1)).otherwise(F.element_at(F.split("path", "/"), -1))
    return rows.select(below.alias("file"), F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that were added, removed or changed between two lists of hashes."""
    a, b = before.select("file", F.col("sha256").alias("was")), after.select("file", F.col("sha256").alias("is_now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is_now").isNull(), "removed").when(F.col("was") != F.col("is_now"), "changed")
    return a.join(b, "file", "full").select("file", change.alias("change")).where("change is not null")


SAMPLE = "struct<timestamp:string,heartRate:string,bodyTemp:string,ambientTemp:string,noise:string,gas:string,uv:string,lat:double,lon:double>"
BATCH = f"helmetId string, workerId string, samples array<{SAMPLE}>, {SAMPLE.removeprefix('struct<').removesuffix('>').replace(':', ' ').replace(',', ', ')}"
CHANNELS = {"heartRate": "heart_rate", "bodyTemp": "body_temperature", "ambientTemp": "ambient_temperature", "noise": "noise", "gas": "gas", "uv": "uv_index"}


def channel(text: Column) -> Column:
    """A channel's number; a text that isn't one, the sentinel -1, NaN and infinities are null."""
    return cleaned(text.try_cast("double"))


def uploads(packets: DataFrame, text: str = "value") -> DataFrame:
    """Samples of uploaded JSON packets in order of receipt: the packet's columns, helmet, worker, place, time, channels, gps, problem.

    A packet has up to MOST_SAMPLES samples, or is a single one in the old form. Packets that can't be read, have no
    helmet, none or too many samples give one row with problem and no values; a sample without a time has a problem of
    its own.
    """
    p = F.from_json(F.col(text), BATCH)
    single = F.struct(*[p[f.split(":")[0]].alias(f.split(":")[0]) for f in SAMPLE.removeprefix("struct<").removesuffix(">").split(",")])
    parsed = packets.withColumn("_p", p).withColumn("_s", F.coalesce("_p.samples", F.when(F.col("_p.timestamp").isNotNull(), F.array(single))))
    n = F.size("_s")
    bad = F.when(F.coalesce(F.col("_p.helmetId"), F.lit("")) == "", "NO_HELMET").when(F.coalesce(n < 1, F.lit(True)), "NO_SAMPLES").when(n > MOST_SAMPLES, "TOO_MANY_SAMPLES")
    rows = parsed.withColumn("_bad", bad).select(
        *packets.columns, F.col("_p.helmetId").alias("helmet"), F.col("_p.workerId").alias("worker"), "_bad", F.posexplode_outer(F.when(F.col("_bad").isNull(), F.col("_s"))).alias("place", "_x")
    )
    time = instant(F.col("_x.timestamp"))
    return rows.select(
        *packets.columns, "helmet", "worker", "place", time.alias("time"), *[channel(F.col(f"_x.{a}")).alias(b) for a, b in CHANNELS.items()], gps(F.col("_x.lat"), F.col("_x.lon")).alias("gps"),
        F.coalesce("_bad", F.when(time.isNull(), "NO_TIME")).alias("problem"),
    )
