"""Timelines within sessions: signals, doses, baselines, votes, transitions, segments and what a chart shows of them.

Rows have worker, session, us (microseconds) and event_id, which orders equal times. Windows are by worker and session or
by worker and day, so they are bounded by a shift; what goes on across sessions is scanned by slices of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wearstream.operators.scans import SECOND, SLICE_SECONDS, in_slices, with_previous, with_running



def by_session() -> WindowSpec:
    return Window.partitionBy("worker", "session").orderBy("us", "event_id")


def so_far() -> WindowSpec:
    return by_session().rowsBetween(Window.unboundedPreceding, 0)


def signal(rows: DataFrame, seconds: int, stat: str, name: str, baseline: Column | None = None) -> DataFrame:
    """A smoothed channel over the session's last seconds: mean, its ratio or its deviation (percent, units) to a baseline, or leq.

    One value is enough; null without any or where a baseline is needed and not above 0.
    """
    f = Window.partitionBy("worker", "session").orderBy("us").rangeBetween(-(seconds * SECOND - 1), 0)
    mean = F.avg("value").over(f)
    if stat == "leq":
        out = 10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("value") / 10)).over(f))
    elif stat == "mean":
        out = mean
    else:
        out = F.when(baseline > 0, {"ratio": mean / baseline, "percent": (mean - baseline) / baseline * 100.0, "units": mean - baseline}[stat])
    return rows.withColumn(name, out)


def shift_dose(rows: DataFrame, per_second: Column, observed: Column, most: float) -> DataFrame:
    """Running dose of a worker's day: only observed samples count, each for the seconds since its session's last, at most most.

    A session's first sample counts for most seconds. The dose goes on over the day's sessions and restarts each day.
    """
    gap = (F.col("us") - F.lag("us").over(by_session())) / SECOND
    credit = F.when(gap.isNull(), float(most)).otherwise(F.least(F.greatest(gap, F.lit(0.0)), F.lit(float(most))))
    day = Window.partitionBy("worker", "day").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("credit", F.when(observed, credit).otherwise(0.0)).withColumn("dose", F.sum(F.col("credit") * per_second).over(day)).drop("credit")


def calibrated(rows: DataFrame, seconds: int, least: int, override: Column | None = None) -> DataFrame:
    """The session's baseline at each row, and whether it is provisional.

    It is the median of the values of the first seconds, from least values on; at the first row past the seconds with
    as many it is frozen. With fewer, later values are still collected until there are as many. An override wins.
    """
    elapsed = (F.col("us") - F.min("us").over(Window.partitionBy("worker", "session"))) / SECOND
    earlier = F.count("value").over(by_session().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_e", elapsed).withColumn("_v", F.when((F.col("_e") < seconds) | (earlier < least), F.col("value")))
    enough = F.count("_v").over(so_far()) >= least
    rows = rows.withColumn("_m", F.when(enough, F.percentile("_v", 0.5).over(so_far())))
    frozen = F.first(F.when(F.col("_e") >= seconds, F.col("_m")), ignorenulls=True).over(so_far())
    given = F.lit(None).cast("double") if override is None else override
    out = rows.withColumn("_f", frozen).withColumn("baseline", F.coalesce(given, F.col("_f"), F.col("_m")))
    return out.withColumn("provisional", given.isNull() & F.col("_f").isNull()).drop("_e", "_v", "_m", "_f")


def votes(rows: DataFrame, accepted: Column, size: int) -> DataFrame:
    """Accepted rows with the majority of their session's last size accepted levels (0, 1, 2); ties go to the more severe."""
    w = by_session().rowsBetween(-(size - 1), 0)
    counted = F.array(*[F.struct(F.count_if(F.col("level") == s).over(w).alias("n"), F.lit(s).alias("s")) for s in range(3)])
    return rows.where(accepted).withColumn("smoothed", F.array_max(counted)["s"])


def changes(rows: DataFrame, state: str) -> DataFrame:
    """Rows whose state differs from their session's one before; a session's first counts unless it is 0."""
    rows = rows.withColumn("before", F.lag(state).over(by_session()))
    return rows.where((F.col(state) != F.col("before")) | (F.col("before").isNull() & (F.col(state) != 0)))


def compressed(rows: DataFrame, gap_seconds: int, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Segments of one state (and, while UNCERTAIN, one reason) without long gaps.

    worker, segment, state, reason, from_us, to_us, n, mean confidence to four digits, and quality: UNCERTAIN, IMPUTED if
    any sample is, else VALID. Rows: state, reason, confidence, quality.
    """
    order = ["us", "event_id"]
    why = F.when(F.col("state") == "UNCERTAIN", F.coalesce("reason", F.lit("")))
    rows = with_previous(in_slices(rows.withColumn("_why", why), slice_seconds), ["us", "state", "_why"], order)
    before = lambda c: F.col("previous").getField(c)
    same = before("us").isNotNull() & F.col("state").eqNullSafe(before("state")) & F.col("_why").eqNullSafe(before("_why")) & (F.col("us") - before("us") <= gap_seconds * SECOND)
    cut = with_running(rows, {"segment": (~F.coalesce(same, F.lit(False))).cast("int")}, order)
    quality = F.when(F.first("state") == "UNCERTAIN", "UNCERTAIN").when(F.bool_or(F.col("quality") == "IMPUTED"), "IMPUTED").otherwise("VALID")
    return cut.groupBy("worker", "segment").agg(
        F.first("state").alias("state"), F.first(F.when(F.col("state") == "UNCERTAIN", F.col("reason"))).alias("reason"), F.min("us").alias("from_us"), F.max("us").alias("to_us"),
        F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"), quality.alias("quality"),
    )


def visible(segments: DataFrame, start_us: int, gap_seconds: int, least_seconds: int) -> DataFrame:
    """Segments as drawn from start_us on: start, end, and whether the next one joins.

    A segment lasts until the next where that begins within the gap, else least_seconds past its last sample; those that
    end before start_us are left out.
    """
    follows = F.lead("from_us").over(Window.partitionBy("worker").orderBy("segment"))
    joins = F.coalesce(follows - F.col("to_us") <= gap_seconds * SECOND, F.lit(False))
    end = F.when(joins, F.greatest(follows, F.col("to_us"))).otherwise(F.col("to_us") + least_seconds * SECOND)
    drawn = segments.withColumn("joins", joins).withColumn("end", end).where(F.col("end") >= start_us)
    return drawn.withColumn("start", F.greatest("from_us", F.lit(start_us)))


def chart_rows(drawn: DataFrame, levels: dict[str, int]) -> DataFrame:
    """Two points for each drawn segment and a break where the next doesn't join: worker, us, level (null for others), break."""
    level = F.element_at(F.create_map(*[F.lit(x) for pair in levels.items() for x in pair]), F.col("state"))
    point = lambda us, lv, gap: F.struct(F.col(us).alias("us"), lv.cast("int").alias("level"), F.lit(gap).alias("break"))
    pause = F.when(~F.col("joins"), point("end", F.lit(None), True))
    points = F.filter(F.array(point("start", level, False), point("end", level, False), pause), lambda p: p.isNotNull())
    return drawn.select("worker", "segment", F.explode(points).alias("p")).select("worker", "segment", "p.*")


def later(segments: DataFrame, points: DataFrame) -> DataFrame:
    """Points with a time that may be appended to a worker's segments: those after the last one's end, each time once."""
    last = segments.groupBy(F.col("worker").alias("_w")).agg(F.max("to_us").alias("_to"))
    fresh = points.where("us is not null").join(last, points.worker == F.col("_w"), "left").where("_to is null or us > _to").drop("_w", "_to")
    return fresh.dropDuplicates(["worker", "us"])


def live(segments: DataFrame, points: DataFrame, gap_seconds: int, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Segments, as `compressed` gives them, with later points (worker, us, event_id, state, reason, confidence, quality).

    Points without a state, and those no later than a worker's last segment, are left out; of equal times the smallest
    event_id counts. A point with the state (and, while UNCERTAIN, the reason) of what is before it within the gap
    extends it, the last segment included: its end, its number of samples, its mean confidence, and a VALID quality to
    IMPUTED. Other points begin segments of their own. The mean of an earlier segment counts once for each of its samples.
    """
    known = points.where("state is not null").withColumn("_first", F.min("event_id").over(Window.partitionBy("worker", "us"))).where(F.col("event_id") == F.col("_first"))
    fresh = later(segments, known)
    why = F.when(F.col("state") == "UNCERTAIN", F.coalesce("reason", F.lit("")))
    given = segments.select(
        "worker", F.col("to_us").alias("us"), F.col("segment").cast("long").alias("event_id"), "state", why.alias("_why"), F.lit(True).alias("_old"), "from_us", "n",
        F.when(F.col("confidence").isNotNull(), F.col("confidence") * F.col("n")).alias("_sum"), F.when(F.col("confidence").isNotNull(), F.col("n")).otherwise(0).alias("_count"), "quality",
    )
    one = fresh.select(
        "worker", "us", F.col("event_id").cast("long").alias("event_id"), "state", why.alias("_why"), F.lit(False).alias("_old"), F.col("us").alias("from_us"), F.lit(1).cast("long").alias("n"),
        F.col("confidence").cast("double").alias("_sum"), F.col("confidence").isNotNull().cast("long").alias("_count"), F.when(F.col("state") == "UNCERTAIN", F.lit("UNCERTAIN")).otherwise(F.col("quality")).alias("quality"),
    )
    order = ["us", "_old", "event_id"]
    rows = with_previous(in_slices(given.unionByName(one), slice_seconds), ["us", "state", "_why"], order)
    before = lambda c: F.col("previous").getField(c)
    joins = ~F.col("_old") & F.col("state").eqNullSafe(before("state")) & F.col("_why").eqNullSafe(before("_why")) & (F.col("us") - before("us") <= gap_seconds * SECOND)
    cut = with_running(rows, {"segment": (~F.coalesce(joins, F.lit(False))).cast("int")}, order)
    first = F.min_by("quality", F.struct(*order))
    quality = F.when((first == "VALID") & F.bool_or(F.coalesce(F.col("quality") == "IMPUTED", F.lit(False))), "IMPUTED").otherwise(first)
    return cut.groupBy("worker", "segment").agg(
        F.first("state").alias("state"), F.first(F.when(F.col("state") == "UNCERTAIN", F.nullif("_why", F.lit("")))).alias("reason"), F.min("from_us").alias("from_us"), F.max("us").alias("to_us"),
        F.sum("n").alias("n"), F.round(F.sum("_sum") / F.nullif(F.sum("_count"), F.lit(0)), 4).alias("confidence"), quality.alias("quality"),
    )


def minute_places(rows: DataFrame) -> DataFrame:
    """Each row's place within its minute, and the minute's rows."""
    minute = F.floor(F.col("us") / (60 * SECOND))
    by = Window.partitionBy("worker", "_minute")
    return rows.withColumn("_minute", minute).withColumn("place", F.row_number().over(by.orderBy("us", "event_id")) - 1).withColumn("in_minute", F.count("*").over(by)).drop("_minute")


def coverage_by_session(rows: DataFrame, first_extra: int) -> DataFrame:
    """Of each session: seconds expected at one row a second, rows kept, and the share missing in percent.

    Expected is from the first minute to the last, of which the last counts as far as it has rows; a worker's first
    session began first_extra seconds earlier, any other at its first minute.
    """
    minutes = rows.groupBy("worker", "session", F.floor(F.col("us") / (60 * SECOND)).alias("minute")).agg(F.count("*").alias("n"))
    one = minutes.groupBy("worker", "session").agg(F.min("minute").alias("a"), F.max("minute").alias("z"), F.max_by("n", "minute").alias("last"), F.sum("n").alias("kept"))
    expected = (F.col("z") - F.col("a") + 1) * 60 - (60 - F.col("last")) + F.when(F.col("session") == 0, first_extra).otherwise(0)
    return one.withColumn("expected", expected).select("worker", "session", "expected", "kept", F.round(100.0 * (F.col("expected") - F.col("kept")) / F.col("expected"), 2).alias("missing_percent"))
