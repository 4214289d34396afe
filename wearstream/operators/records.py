"""Stored records as folds over event logs: batches taken apart, upserts, first and bulk updates, fan-out, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alerts and recipients of a task of a fan-out. Parquet packs 504 numbers at a time: only lists of a multiple repeat byte by byte.
LISTED, GIVEN = 1008, 1 << 14


def find(rows: DataFrame, where: dict, fields: list[str]) -> DataFrame:
    """The named fields of rows equal to all given values; a value may be a list of alternatives, or None for null."""
    for name, value in where.items():
        c = F.col(name)
        rows = rows.where(c.isNull() if value is None else c.isin(value) if isinstance(value, list) else c == value)
    return rows.select(*fields)


def filtered(rows: DataFrame, *, owner: tuple[str, object] | None = None, since: Column | None = None, **equal) -> DataFrame:
    """Rows by optional filters: those given as None don't count; owner, where given, always does."""
    if owner:
        rows = rows.where(F.col(owner[0]) == F.lit(owner[1]))
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows if since is None else rows.where(F.col("ts") >= since)


def unpacked(batches: DataFrame, samples: str, most: int) -> DataFrame:
    """One row per sample of each batch with its place, in order of receipt; batches of none or too many give one row with problem."""
    n = F.size(samples)
    bad = F.coalesce((n < 1) | (n > most), F.lit(True))
    checked = batches.withColumn("problem", F.when(bad, "INVALID_BATCH"))
    rest = [c for c in batches.columns if c != samples]
    return checked.select(*rest, "problem", F.posexplode_outer(F.when(~bad, F.col(samples))).alias("place", "sample"))


def last_state(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """An upsert's outcome: each key's fields as its last event left them, nulls included."""
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("row")).select(key, "row.*")


def first_write(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Each key's fields by its first event; later ones change nothing."""
    return events.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("row")).select(key, "row.*")


def updated(rows: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    """All rows, with the changes in those that satisfy where."""
    hit = F.coalesce(where, F.lit(False))
    return rows.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in rows.columns])


def _listed(ids: DataFrame, n: int) -> DataFrame:
    """The distinct values of n rows' only column, null too, in partitions of LISTED but for the last of each 64."""
    name, parts = ids.columns[0], n // (64 * LISTED) + 1
    each = n // parts // LISTED + 2
    numbered = ids.repartition(parts, name).distinct().sortWithinPartitions(name).withColumn("_n", F.monotonically_increasing_id())
    part = F.shiftright("_n", 33) + parts * F.floor(F.col("_n").bitwiseAND((1 << 33) - 1) / LISTED)  # from bit 33 on, the partition's number
    return numbered.select(name, F.pmod(part, F.lit(parts * each)).cast("int").alias("_part")).repartitionById(parts * each, "_part").select(name)


def fanned_out(alerts: DataFrame, recipients: DataFrame, own: str) -> DataFrame:
    """One row per alert and recipient, and one for the alert's own worker: event_id, recipient.

    The result has as many rows as alerts times recipients; none is twice in it, also where a worker is a recipient or an
    alert is given twice. Null recipients and workers get none. Both may be any number: a task gives LISTED alerts to one
    recipient after the other, GIVEN at most, about. So files hold a run for each recipient and the same alerts again and
    again, which take a tenth of a byte a row; nothing is written or sent once it is multiplied.
    """
    named = recipients.select("recipient").where("recipient is not null")
    everyone = named.repartition(named.count() // GIVEN + 1, "recipient").distinct()
    events = _listed(alerts.select("event_id"), alerts.count())
    to_all = everyone.crossJoin(events.hint("shuffle_replicate_nl")).select("event_id", "recipient")
    to_own = alerts.select("event_id", F.col(own).alias("recipient")).where("recipient is not null").distinct()
    return to_all.unionByName(to_own.join(everyone, "recipient", "left_anti").select("event_id", "recipient"))


def retained(rows: DataFrame, now: Column, days: int) -> DataFrame:
    """Rows not older than days."""
    return rows.where(F.col("ts") >= now - F.expr(f"interval '{days}' day"))


def next_id(rows: DataFrame, column: str, prefix: str, width: int) -> DataFrame:
    """The id after the largest of a prefix, by number; the first where there is none."""
    number = F.regexp_extract(F.col(column), f"^{prefix}([0-9]+)$", 1)
    largest = F.max(F.when(number != "", number.cast("long")))
    return rows.agg(F.concat(F.lit(prefix), F.lpad((F.coalesce(largest, F.lit(0)) + 1).cast("string"), width, "0")).alias("next_id"))


def public(rows: DataFrame, hidden: list[str]) -> DataFrame:
    """The rows without hidden columns, where they have them."""
    return rows.drop(*hidden)


def conflicts(rows: DataFrame, key: str, unique: list[str]) -> DataFrame:
    """For each column that must be unique: the values that several keys have, with the keys' number."""
    long = rows.select(key, *[F.col(c).cast("string").alias(c) for c in unique]).unpivot([key], unique, "field", "value").where("value is not null")
    return long.groupBy("field", "value").agg(F.count_distinct(key).alias("keys")).where("keys > 1")


def deduplicated(rows: DataFrame, key: list[str], priority: Column, order: list[str]) -> DataFrame:
    """Of each key the row with the highest priority, the first on ties."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(priority, *[-F.col(c) for c in order]))
    return rows.groupBy(*key).agg(best.alias("row")).select(*key, "row.*")


def duplicates(rows: DataFrame) -> DataFrame:
    """Rows that occur more than once, and how often."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("times")).where("times > 1")
