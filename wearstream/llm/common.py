"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of k consecutive word hashes: differences of one polynomial's running sums."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power_table(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * down[:n] + odd_constants(1, 64 * seed + k)[0])


class Held:
    """A sorted table of hashes, asked for many at once: most are ruled out by one bit each."""

    def __init__(self, hashes: np.ndarray):
        self.table = np.sort(hashes)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.table >> np.uint64(44)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes the table holds, by their places, and where it holds them."""
        some = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        if not len(some):
            return some, some
        at = np.minimum(np.searchsorted(self.table, hashes[some]), len(self.table) - 1)
        yes = self.table[at] == hashes[some]
        return some[yes], at[yes]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that long texts don't add up in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, which the cluster names in spark.checkpoint.dir.

    Where it names none, a temporary one does in local mode (tests); on a cluster, whose machines share no such folder,
    it raises.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so lost executors cost no recomputation of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether an execution's shuffle files go at its end; else they stay until the driver's JVM happens to collect garbage.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; the shuffle files that this took are gone then."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(FILES_GO, "false")
    conf.set(FILES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(FILES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Takes the files of a table that written() made, and that nothing reads any more, out of the shared folder."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes of words: all but ASCII white space; and ASCII letters, digits and whatever isn't ASCII.
NOT_SPACE = _flags(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))
ALNUM = _flags(bytes(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << n.bit_length()
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_spans(data: bytes, members: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a UTF-8 text begin and end, in bytes."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = members[np.frombuffer(data, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH3's 64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The words between ASCII white space, in UTF-8; A-Z lower-cased if asked."""
    data = (text or "").encode("utf-8", "replace")
    return (data.translate(LOWER) if lower else data).split()


def hashed_words(text: str | None, lower: bool = False) -> np.ndarray:
    return word_hashes(words_of(text, lower))


def marked_bits(ids: DataFrame, column: str, bits: int = 24) -> DataFrame:
    """A bitmap of a column's hashes as a table (word, mask) of at most 2 ** (bits - 6) rows, so it can be broadcast at any size."""
    place = F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1))
    return ids.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(xxhash64(`{column}`) & 63 as int))")).alias("mask"))


def perhaps_in(rows: DataFrame, column: str, bitmap: DataFrame, name: str, bits: int = 24) -> DataFrame:
    """rows with a boolean column name: false only for values that the bitmap's table doesn't hold; true for few others."""
    place = F.shiftright(F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1)), 6)
    held = F.broadcast(bitmap.select(F.col("word").alias(f"{name}_word"), F.col("mask").alias(f"{name}_mask")))
    bit = F.expr(f"shiftleft(1L, cast(xxhash64(`{column}`) & 63 as int))").bitwiseAND(F.col(f"{name}_mask"))
    return rows.join(held, place == F.col(f"{name}_word"), "left").withColumn(name, F.coalesce(bit != 0, F.lit(False))).drop(f"{name}_word", f"{name}_mask")


def components(edges: DataFrame) -> DataFrame:
    """The smallest vertex that each vertex of edges (a, b) reaches: node, component.

    Each round every vertex takes the smallest of its neighbours and itself as parent, then its parent's parent, and the
    edges are contracted: those within a parent vanish and equal ones merge, so a round costs what is left. A vertex
    that is left after a round has taken in a neighbour, or has a smaller neighbour by then and merges in the next one,
    so two rounds at least halve the vertices. The rounds' parents are composed at the end. Tables are checkpointed each
    round. No edges give no rows.
    """

    def between(a: str, b: str, table: DataFrame) -> DataFrame:
        return checkpointed(table.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())

    left, rounds = between("a", "b", edges), []
    while not rounds or not left.isEmpty():
        down = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        ends = down.unionByName(left.select(F.col("a").alias("node"), F.col("a").alias("parent")).distinct())
        first = checkpointed(ends.groupBy("node").agg(F.min("parent").alias("parent")))
        second = first.select(F.col("node").alias("via"), F.col("parent").alias("far"))
        parents = checkpointed(first.join(second, first.parent == second.via).select("node", F.col("far").alias("parent")))
        pa_, pb_ = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        left = between("pa", "pb", left.join(pa_, "a").select("pa", "b").distinct().join(pb_, "b"))
        rounds.append(parents)
    found = rounds[-1].select("node", F.col("parent").alias("component"))
    for parents in reversed(rounds[:-1]):
        later = found.select(F.col("node").alias("via"), "component")
        found = parents.join(later, parents.parent == later.via, "left").select("node", F.coalesce("component", "parent").alias("component"))
    return checkpointed(found)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: str, max_rows: int) -> DataFrame:
    """Whole texts and 0/1 labels (text, y) of at most max_rows labelled rows that satisfy train, for fitting a model.

    The rows are those with the smallest hashes of their ids, so the sample is the same at every partitioning and its
    list of ids is small enough to broadcast. Null texts are empty; null labels and ids are left out.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(train).groupBy(F.col("doc_id").alias("labelled_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(max_rows)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(checkpointed(chosen)), F.col("doc_id") == F.col("labelled_id"))
    return written(rows.repartition(16, F.xxhash64("doc_id", "text")).select("text", "y"), "sample")
