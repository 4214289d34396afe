"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

A sketch of t coordinates is filled in rounds. In each of the first t rounds every element of the set is thrown into one
coordinate with a value that begins with the round's number, and the smallest value stays; in round t + i all elements
go to coordinate i. A set is done after the round that fills its last coordinate, as later rounds have larger values only. So
every coordinate is filled, a large set needs a round or two, and the share of equal coordinates of two sets is as
concentrated about their Jaccard similarity as if the coordinates were independent. Both thresholds below rest on that.

Sets that agree in a band of coordinates are candidates. First each set meets one leader, that with which it shares the
most bands; what that links is one component each. Then only bands that hold several components matter: their members,
but for pairs inside the band's largest component, meet in tiles of bounded size, where sketches rule out unlike pairs. The
others are verified on full sets, either pair by pair or, where a tile has many, inside the tile until its components
are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearstream.llm.common import components, marked_bits, mix64, odd_constants, perhaps_in, small_batches, written
from wearstream.llm.jaccard_join import linked, set_key_of, shingles

#: The chance that banding misses a pair at the threshold is at most this; sketches rule pairs out SIGMAS deviations below it.
MISS = 1e-6
SIGMAS = 7
#: Bands that a set shares with its leader at least; pairs that a tile hands on for each of its members, else it is dense and
#: its members, which are fewer, are sent.
LEADER_BANDS = 3
PAIRS_EACH = 1
#: Members that one copy of a leader's text meets.
CHUNK = 256
LOW = np.uint64(0xFFFFFFFF)


@cache
def banding(t: int, percent: int) -> tuple[int, int]:
    """Bands and rows of each: as many rows as keep the chance of missing a pair at the threshold within MISS."""
    rows = max((r for r in range(1, t + 1) if (1 - (percent / 100) ** r) ** (t // r) <= MISS), default=1)
    return t // rows, rows


def least_agreement(t: int, percent: int) -> int:
    """Equal coordinates below which a pair isn't linked: SIGMAS standard deviations under the threshold's mean."""
    p = percent / 100
    return max(0, floor(t * (p - SIGMAS * sqrt(p * (1 - p) / t))))


def fast_sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates for each set, none of which may be empty."""
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, np.uint64)
    sizes = [len(s) for s in sets]
    x, owner = np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    salts = odd_constants(2 * t, 7919)
    for r in range(2 * t):
        if not len(x):
            break
        h = mix64(x + salts[r])
        place = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if r < t else np.full(len(x), r - t)
        np.minimum.at(out, owner * t + place, (h & LOW) | np.uint64(r << 32))
        filled = (out.reshape(-1, t) != np.iinfo(np.uint64).max).all(axis=1)
        if filled.any():
            rest = ~filled[owner]
            x, owner = x[rest], owner[rest]
    return out.reshape(-1, t)


def bands_of(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bands' hashes, in which a band's number counts."""
    parts = sketches[:, : bands * rows].reshape(-1, bands, rows)
    return mix64((mix64(parts) * odd_constants(rows, 104729)).sum(axis=2, dtype=np.uint64) + odd_constants(bands, 1299709)).view(np.int64)


def short(sketches: np.ndarray) -> np.ndarray:
    """A byte of each coordinate; unequal ones agree in it once in 256 times."""
    return (mix64(sketches) & np.uint64(0xFF)).astype(np.uint8)


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a column of byte strings that are all as wide."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def close_pairs(tile: np.ndarray, comp: np.ndarray, side: np.ndarray, sketch: np.ndarray, bands: np.ndarray, band: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a tile (rows are in order of tile) with at least as many equal coordinates.

    Left out are pairs of one component, of one side where a tile has two (side isn't 0), and those that share an earlier
    band, where they meet too.
    """
    found = [(np.empty(0, np.int64),) * 2]
    size = np.diff(np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True])).max(initial=0)
    for k in range(1, int(size)):
        a = np.flatnonzero((tile[k:] == tile[:-k]) & (comp[k:] != comp[:-k]) & ((side[k:] == 0) | (side[k:] != side[:-k])))
        a = a[(sketch[a] == sketch[a + k]).sum(axis=1) >= least]
        here = bands[a, (bands[a] == bands[a + k]).argmax(axis=1)] == band[a] if len(a) else np.empty(0, bool)
        found.append((a[here], a[here] + k))
    return tuple(np.concatenate(x) for x in zip(*found))


def joined_components(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, least: int, percent: int, t: int, band: int | None = None) -> list[tuple[int, int]]:
    """Links between components of a tile's sets, verified in full, the likeliest first, until none is left to join.

    Given the tile's band, pairs that share an earlier one are left out, as they meet there too.
    """
    if len(sets) < 2:
        return []
    root = {int(c): int(c) for c in comp}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    full = fast_sketches(sets, t)
    sketch, bands, sizes, out = short(full), bands_of(full, *banding(t, percent)), np.array([len(s) for s in sets]), []
    for i in range(len(sets)):
        agree = (sketch[:i] == sketch[i]).sum(axis=1)
        likely = np.flatnonzero((agree >= least) & (comp[:i] != comp[i]) & ((side[:i] == 0) | (side[:i] != side[i])))
        if band is not None:
            likely = likely[bands[i, (bands[likely] == bands[i]).argmax(axis=1)] == band]
        for j in sorted(likely.tolist(), key=lambda j: -agree[j]):
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b and linked(np.intersect1d(sets[i], sets[j], assume_unique=True).size, int(sizes[i]), sizes[j], percent):
                root[max(a, b)] = min(a, b)
                out.append((int(comp[i]), int(comp[j])))
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches in tables that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        where = np.stack([rows.column(c).to_numpy() for c in keys])
        cut = int(np.flatnonzero(np.r_[True, (where[:, 1:] != where[:, :-1]).any(axis=0)])[-1])
        if cut:
            yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, t: int = 200, tile: int = 512) -> DataFrame:
    """Every document with its set's size and its class of near-duplicates: doc_id, n_shingles, component_id, kept.

    Sets are distinct shingles of size words (A-Z lower-cased), the whole sequence where it has fewer; two documents
    link when 100 * intersection >= percent * union, which is confirmed on full sets; component_id is the smallest
    doc_id that links reach, and kept says whether it is the document's own. Copies with equal sets are one
    representative from the start. With t = 200 and 80 %, 40 bands of 5 rows miss a pair at the threshold with a
    chance of 1.3e-7, and sketches rule one out with less than 1e-10.

    A null or wordless text has n_shingles 0 and is its own class; rows with a null doc_id are linked with nothing,
    have a null component_id and are kept; an id repeated with different texts keeps a row and a class for each; equal
    rows share their class; an empty table gives no rows; other columns aren't read. Texts are whole. A task holds one
    tile, at most 2 * tile sketches, or sets where it is dense.
    """
    n_bands, rows = banding(t, percent)
    least = least_agreement(t, percent)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            sets = [shingles(x, size) for x in batch.column(1).to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            full = fast_sketches([sets[i] for i in some], t)
            short_of, bands = dict(zip(some, short(full))), dict(zip(some, bands_of(full, n_bands, rows)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key_of(s) for s in sets], pa.int64()),
                    pa.array([short_of[i].tobytes() if i in short_of else None for i in range(len(sets))], pa.binary()), pa.array([bands.get(i) for i in range(len(sets))], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "set_key", "sketch", "bands"],
            )

    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    members = written(texts.mapInArrow(sketched, "doc_id long, n long, set_key long, sketch binary, bands array<long>"), "sketches")
    usable = members.where("n > 0 and doc_id is not null")
    reps = usable.groupBy(F.col("set_key").alias("key")).agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands"))
    reps = written(reps, "representatives")

    # leaders: of each band the smallest key, and of each set the leader with which it shares the most bands
    in_bands = reps.select("key", F.explode("bands").alias("band"))
    shared = written(in_bands.groupBy("band").agg(F.min("key").alias("leader"), F.count("*").alias("many")).where("many > 1").select("band", "leader"), "shared-bands")
    bitmap = written(marked_bits(shared, "band"), "shared-bits")
    met = perhaps_in(in_bands, "band", bitmap, "shared").where("shared").select("key", "band").join(shared, "band").where("key <> leader")
    stars = met.groupBy("key", "leader").agg(F.count("*").alias("times")).where(F.col("times") >= LEADER_BANDS)
    best = stars.groupBy("key").agg(F.max_by("leader", F.struct("times", "leader")).alias("leader"))
    links = written(verified(best.select(F.col("leader").alias("a"), F.col("key").alias("b"), F.col("leader").alias("ca"), F.col("key").alias("cb")), reps, texts, size, percent), "star-links")
    early = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    labelled = written(reps.join(early, reps.key == early.node, "left").select("key", "rep", "sketch", "bands", F.coalesce("component", "key").alias("comp")), "labelled")

    # bands that hold several components; their largest one is the bulk, whose own pairs are settled
    held = perhaps_in(labelled.select("key", "comp", F.explode("bands").alias("band")), "band", bitmap, "shared").where("shared").select("key", "comp", "band")
    counts = held.groupBy("band", "comp").agg(F.count("*").alias("count"))
    mixed = counts.groupBy("band").agg(F.max_by("comp", F.struct("count", "comp")).alias("bulk"), F.max("count").alias("most"), F.sum("count").alias("many")).where("many > most")
    few = F.col("many") <= tile
    parts = mixed.select("band", "bulk", F.when(few, 1).otherwise(F.ceil((F.col("many") - F.col("most")) / tile)).cast("int").alias("loose_parts"), F.when(few, 0).otherwise(F.ceil(F.col("most") / tile)).cast("int").alias("bulk_parts"))
    dealt = held.join(written(parts, "mixed-bands"), "band").withColumn("is_bulk", F.col("comp") == F.col("bulk"))
    salt = F.xxhash64("key")
    apart = F.col("is_bulk") & (F.col("bulk_parts") > 0)
    dealt = dealt.withColumn("part", F.when(apart, F.col("loose_parts") + F.pmod(salt, F.greatest(F.col("bulk_parts"), F.lit(1)))).otherwise(F.pmod(salt, F.col("loose_parts"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(apart, F.col("loose_parts")).otherwise(F.col("loose_parts") + F.col("bulk_parts")) - 1)
    tiles = dealt.withColumn("other", F.explode(others)).select(
        "key", "comp", "band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side")
    )
    tiles = tiles.join(labelled.select(F.col("key").alias("k"), "sketch", "bands"), F.col("key") == F.col("k")).drop("k")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["band", "low", "high"]):
            key, comp, side, band, low, high = (group.column(c).to_numpy() for c in ("key", "comp", "side", "band", "low", "high"))
            number = np.cumsum(np.r_[True, (band[1:] != band[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) - 1
            a, b = close_pairs(number, comp, side, fixed(group.column("sketch").combine_chunks(), t), np.stack(group.column("bands").to_numpy()), band, least)
            dense = np.bincount(number[a], minlength=number[-1] + 1) > PAIRS_EACH * np.bincount(number)
            thin, rest = ~dense[number[a]], np.flatnonzero(dense[number])
            a, b = a[thin], b[thin]
            at, other, crowded = np.r_[a, rest], np.r_[b, rest], np.r_[np.zeros(len(a), bool), np.ones(len(rest), bool)]
            columns = [key[at], key[other], comp[at], comp[other], band[at], low[at], high[at], side[at], crowded]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "ca", "cb", "band", "low", "high", "side", "dense"])

    sorted_tiles = tiles.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "key")
    found = written(sorted_tiles.mapInArrow(compared, "a long, b long, ca long, cb long, band long, low int, high int, side int, dense boolean"), "close-pairs")
    thin = verified(found.where("not dense").select("a", "b", "ca", "cb"), reps, texts, size, percent)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, of = None, [], []
        joined = lambda: pairs_of(joined_components(sets, *np.array(of, np.int64).reshape(-1, 2).T, least, percent, t, at and at[0]))
        for batch in batches:
            for band, low, high, key, comp, side, text in zip(*(batch.column(c).to_pylist() for c in ("band", "low", "high", "key", "comp", "side", "text"))):
                if (band, low, high) != at:
                    yield joined()
                    at, sets, of = (band, low, high), [], []
                s = shingles(text, size)
                if set_key_of(s) == key:
                    sets.append(s)
                    of.append((comp, side))
        yield joined()

    crowd = with_texts(found.where("dense").select(F.col("a").alias("key"), F.col("ca").alias("comp"), "band", "low", "high", "side"), reps, texts)
    crowd = crowd.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "key").mapInArrow(settled, "ca long, cb long")
    late = components(written(thin.select("ca", "cb").union(crowd), "late-links").select(F.col("ca").alias("a"), F.col("cb").alias("b")))

    final = labelled.select("key", "rep", "comp").join(late, F.col("comp") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "comp").alias("comp"))
    final = written(final, "classes")
    least_id = final.groupBy(F.col("comp").alias("c")).agg(F.min("rep").alias("component_id"))
    named = final.join(least_id, F.col("comp") == F.col("c")).select("key", "component_id")
    out = members.join(named, F.col("set_key") == F.col("key"), "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def pairs_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["ca", "cb"])


def with_texts(rows: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """rows (with a key) and the representative's text; an id with several texts gives a row for each of them.

    Only texts of wanted ids, and few others, are exchanged.
    """
    named = written(rows.join(reps.select(F.col("key").alias("k"), "rep"), F.col("key") == F.col("k")).drop("k"), "wanted")
    needed = perhaps_in(texts.where("doc_id is not null"), "doc_id", written(marked_bits(named, "rep"), "wanted-bits"), "needed").where("needed").drop("needed")
    return named.hint("merge").join(needed, F.col("rep") == F.col("doc_id")).drop("rep", "doc_id")


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b, ca, cb) whose full sets are linked.

    Members b meet their a in chunks of about CHUNK, to each of which a copy of its text goes.
    """
    chunks = pairs.groupBy(F.col("a").alias("of")).agg(F.count("*").alias("many")).select("of", (F.floor(F.col("many") / CHUNK) + 1).alias("chunks"))
    dealt = pairs.join(chunks, F.col("a") == F.col("of")).withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")))
    dealt = written(dealt.select("a", "b", "ca", "cb", "chunk"), "pairs")
    heads = dealt.select(F.col("a").alias("key"), "a", "chunk").distinct().select("key", "a", "chunk", F.lit(None).cast("long").alias("ca"), F.lit(None).cast("long").alias("cb"), F.lit(0).alias("member"))
    wanted = heads.union(dealt.select(F.col("b").alias("key"), "a", "chunk", "ca", "cb", F.lit(1).alias("member")))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None
        for batch in small_batches(batches, 128):
            links = []
            for key, a, chunk, ca, cb, member, text in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "chunk", "ca", "cb", "member", "text"))):
                if (a, chunk) != at:
                    at, head = (a, chunk), None
                s = shingles(text, size)
                if set_key_of(s) != key:
                    continue
                if not member:
                    head = s
                elif head is not None and linked(np.intersect1d(head, s, assume_unique=True).size, len(head), len(s), percent):
                    links.append((ca, cb))
            yield pairs_of(links)

    found = with_texts(wanted, reps, texts).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "member", "key")
    return found.mapInArrow(checked, "ca long, cb long")
