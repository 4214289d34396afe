"""Mixing sources to target weights by Pfair scheduling, in SQL functions alone."""

from __future__ import annotations

import heapq
import itertools
import math
import uuid
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearstream.llm.common import checkpointed, shared_dir

#: A period is repeated until it has as many slots.
LEAST_SLOTS = 1024
#: So many rows of the schedule are on the driver at once, and slots are numbered in ranges of so many.
SLOTS_AT_ONCE = 1 << 16
OURS = ["mix_source", "mix_block", "mix_release", "mix_due", "mix_slot", "mix_place"]


def whole_weights(weights: dict) -> dict[object, int]:
    """The weights as the smallest whole numbers in the same proportions; floats count as their decimal forms."""
    exact = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    if exact and min(exact.values()) <= 0:
        raise ValueError("weights must be positive")
    unit = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * unit) for s, x in exact.items()}
    divisor = math.gcd(*whole.values()) or 1
    return {s: n // divisor for s, n in whole.items()}


def slots_needed(weights: dict[object, int], blocks: dict[object, int]) -> int:
    """Slots by whose end so many blocks of each source are due, or the period's if it is shorter."""
    total = sum(weights.values())
    return min(total, max((-(-blocks[s] * total // w) for s, w in weights.items()), default=0))


def turns(weights: dict[object, int], slots: int | None = None) -> Iterator[tuple[object, int]]:
    """(source, its block's number) for each slot of one period, or its first slots, by earliest deadline first among the released.

    With w the source's share of the weights, block i is released at floor(i / w) and due at ceil((i + 1) / w). The period
    is the weights' sum, in which a source has as many blocks as its weight, so one period after the other goes on as if
    the first had not ended. The shares sum up to 1, so a released block is always there and none is late; at every slot
    a source is less than one block from its share.
    """
    total, names = sum(weights.values()), sorted(weights, key=lambda s: (s is not None, s))
    coming, ready = [(0, n, 0) for n in range(len(names))], []
    for slot in range(total if slots is None else min(slots, total)):
        while coming and coming[0][0] <= slot:
            _, n, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[names[n]]), n, i))
        due, n, i = heapq.heappop(ready)
        if due < slot + 1:
            raise AssertionError("a deadline was missed")
        yield names[n], i
        if i + 1 < weights[names[n]]:
            heapq.heappush(coming, ((i + 1) * total // weights[names[n]], n, i + 1))


def kept_rows(spark: SparkSession, rows: Iterator[tuple], schema: str, name: str) -> DataFrame:
    """Rows that the driver makes, written to the shared folder a bounded number at a time, and read again."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    chunk = list(itertools.islice(rows, SLOTS_AT_ONCE))
    while True:
        spark.createDataFrame(chunk, schema).write.mode("append").parquet(path)
        chunk = list(itertools.islice(rows, SLOTS_AT_ONCE))
        if not chunk:
            return spark.read.schema(schema).parquet(path)


def mix_sources(docs: DataFrame, *, weights: dict | None = None, block_rows: int = 64, range_bits: int = 12) -> DataFrame:
    """The documents with their place in the mixture; no row is lost.

    Each source's rows in order of doc_id make blocks of block_rows, which take the slots of `turns`, period after
    period: until a source has ended, every source's blocks are less than one from its weight's share at every slot.
    Slots of ended sources close up, so the others go on in the same order and mix_slot has no gaps. Adds mix_source,
    mix_block (of its source), mix_release and mix_due (that block's, in slots before they close up), mix_slot, and
    mix_place (within the block); sorting by mix_slot and mix_place gives the mixture.

    weights are positive numbers; a source that isn't named gets the least one named. None means the whole part of the
    square roots of the sources' row counts. A null source is a source of its own. Null doc_ids come first in their
    source; rows of one doc_id are in the order of a hash of the row, and equal rows are interchangeable. Input columns
    with the six names are replaced; no other name matters. An empty table gives no rows. Texts aren't looked at.

    The driver makes one period, of which it holds SLOTS_AT_ONCE slots at a time besides a number for each source: a slot
    for each unit of the weights' sum, but none after all blocks of the table are due, so weights of many digits make no
    more slots than the table can use. Slots are numbered in ranges, so no task has a whole period. Numbers within a source come from counts by ranges of ids, so a source with most rows isn't gathered in a task; rows with one
    doc_id, or of one range of 2 ** range_bits ids, are.
    """
    spark, columns = docs.sparkSession, [c for c in docs.columns if c not in OURS]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    rows = docs.select(row.alias("row"), F.col("source").cast("string").alias("s"), F.col("doc_id").cast("long").alias("id"))
    rows = rows.withColumn("r", F.shiftright("id", range_bits))
    ranges = checkpointed(rows.groupBy("s", "r").count())
    counted = {r["s"]: r["n"] for r in ranges.groupBy("s").agg(F.sum("count").alias("n")).collect()}
    least = min(weights.values(), default=1) if weights else 1
    share = whole_weights({s: math.isqrt(n) for s, n in counted.items()} if weights is None else {s: weights.get(s, least) for s in counted})
    total = sum(share.values())
    times = -(-LEAST_SLOTS // total) if total else 1
    blocks_of = {s: -(-n // block_rows) for s, n in counted.items()}
    slots = slots_needed(share, blocks_of)
    period = ((s, k * share[s] + i, k * total + slot) for k in range(times) for slot, (s, i) in enumerate(turns(share, total if times > 1 else slots)))
    of_source = [(s, times * share[s], share[s], blocks_of[s]) for s in counted]
    place_in = kept_rows(spark, period, "s string, j long, at long", "mix-period")
    sources = F.broadcast(spark.createDataFrame(of_source, "s string, each long, part long, blocks long"))  # a row per source

    # every source's blocks with their slots: whole periods first, so that a source with most blocks is dealt out
    laps = sources.select("s", "each", "part", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("blocks") - 1) / F.col("each")).cast("long"))).alias("lap")).repartition("lap", "s")
    place_in = place_in.select(F.col("s").alias("ps"), "j", "at")
    blocks = laps.join(place_in, F.col("s").eqNullSafe(F.col("ps"))).withColumn("block", F.col("lap") * F.col("each") + F.col("j")).where("block < blocks")
    blocks = blocks.withColumn("slots", F.floor(F.col("at") / SLOTS_AT_ONCE).cast("long"))
    sizes = blocks.groupBy("lap", "slots").agg(F.count("*").alias("size"))
    by = ["lap", "slots"]  # a row per LEAST_SLOTS slots or more
    starts = sizes.select(F.col("lap").alias("l"), F.col("slots").alias("ls"), (F.sum("size").over(Window.orderBy(*by)) - F.col("size")).alias("start"))
    blocks = blocks.withColumn("in_range", F.row_number().over(Window.partitionBy(*by).orderBy("at")) - 1).join(starts, (F.col("lap") == F.col("l")) & (F.col("slots") == F.col("ls")))
    exact = F.lit(total).cast("decimal(20,0)")
    blocks = blocks.select(
        F.col("s").alias("bs"), F.col("block").alias("mix_block"), (F.col("start") + F.col("in_range")).alias("mix_slot"),
        F.floor(F.col("block") * exact / F.col("part")).cast("long").alias("mix_release"), F.ceil((F.col("block") + 1) * exact / F.col("part")).cast("long").alias("mix_due"),
    )

    before = ranges.select(F.col("s").alias("ns"), F.col("r").alias("nr"), (F.sum("count").over(Window.partitionBy("s").orderBy(F.col("r").asc_nulls_first())) - F.col("count")).alias("before"))
    in_range = F.row_number().over(Window.partitionBy("s", "r").orderBy(F.col("id").asc_nulls_first(), F.xxhash64("row"))) - 1
    numbered = rows.withColumn("in_range", in_range).join(before, F.col("s").eqNullSafe(F.col("ns")) & F.col("r").eqNullSafe(F.col("nr"))).withColumn("n", F.col("before") + F.col("in_range"))
    numbered = numbered.select("row", "s", F.floor(F.col("n") / block_rows).cast("long").alias("b"), F.pmod("n", F.lit(block_rows)).cast("long").alias("mix_place"))
    mixed = numbered.join(blocks, F.col("s").eqNullSafe(F.col("bs")) & (F.col("b") == F.col("mix_block")))
    return mixed.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("s").alias("mix_source"), "mix_block", "mix_release", "mix_due", "mix_slot", "mix_place")
