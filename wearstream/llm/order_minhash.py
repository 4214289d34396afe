"""Document fingerprints by Order MinHash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearstream.llm.common import mix64, odd_constants, small_batches, window_hashes, written


#: Values whose products in all orders are held at a time, so that they stay in the cache.
BLOCK = 2048


@lru_cache
def salts_of(tuples: int) -> np.ndarray:
    return odd_constants(tuples, 400)


def occurrences(mers: np.ndarray) -> np.ndarray:
    """How many equal values came before each."""
    n = len(mers)
    low = np.uint64((1 << n.bit_length()) - 1)  # a value's last bits make room for its place: plain sorting is the faster
    order = (np.sort((mers & ~low) | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
    ranked = mers[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    if (new[1:] & ((ranked[1:] ^ ranked[:-1]) <= low)).any():  # unequal values that only the last bits tell apart may lie mixed
        order = np.argsort(mers, kind="stable")
        ranked = mers[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
    rank, number = np.arange(n), np.empty(n, np.uint64)
    number[order] = rank - np.maximum.accumulate(np.where(new, rank, 0))
    return number


def least_places(values: np.ndarray, salts: np.ndarray, width: int) -> np.ndarray:
    """For each salt, the places of the width least products with it, smallest first: the least of each block's least."""
    tuples = np.arange(len(salts))
    held, ranks, places = np.empty(len(salts) * min(len(values), BLOCK), np.uint64), [], []
    for at in range(0, len(values), BLOCK):
        block = values[at : at + BLOCK]
        products = held[: len(salts) * len(block)].reshape(len(salts), len(block))
        np.multiply(salts[:, None], block, out=products)
        for _ in range(min(width, len(block))):
            least = products.argmin(axis=1)
            ranks.append(products[tuples, least])
            places.append(least + at)
            products[tuples, least] = np.iinfo(np.uint64).max
    ranks, places = np.stack(ranks, axis=1), np.stack(places, axis=1)
    return np.take_along_axis(places, np.argsort(ranks, axis=1, kind="stable")[:, :width], axis=1)


def sketch(text: str, *, k: int = 5, tuples: int = 40, length: int = 2) -> np.ndarray:
    """The hashes of tuples of k-mers: for each of the orders, the length least k-mers in the text's order.

    Equal k-mers are told apart by how many came before, so each is drawn once. A text with fewer k-mers than length
    gives all it has; one with fewer than k characters counts as a single k-mer.
    """
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    mers = window_hashes(chars, min(k, len(chars)), seed=9) if len(chars) else np.zeros(1, np.uint64)
    numbered = mix64(mers + mix64(occurrences(mers) + np.uint64(1)))
    width = min(length, len(mers))
    picks = least_places(numbered, salts_of(tuples), width)
    picks.sort(axis=1)
    value = np.arange(1, tuples + 1, dtype=np.uint64)
    for j in range(width):
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + mers[picks[:, j]])
    return (value & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited_text(text: str, following: str) -> str:
    """text with its last half, rounded down, replaced by as many first characters of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, *, k: int = 5, tuples: int = 40, length: int = 2) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The next document is the one with the next smaller doc_id; the largest comes after the last. The texts are dealt by
    ranges of doc_id and sorted, so neighbours meet in a task; each task also hands on its first and last document,
    and those few meet their neighbours in a small join. A null text is empty; a null doc_id sorts last, and rows with
    one doc_id are in the order of their texts' hashes; a sole document is its own next; an empty table gives no rows.
    Texts are whole.
    """

    def row(doc_id, text, mark, following, following_mark):
        edited = edited_text(text, following)
        edited_mark = sketch(edited, k=k, tuples=tuples, length=length)
        return {
            "doc_id": doc_id, "n_chars": len(text), "edited_sha256": sha256(edited.encode("utf-8", "replace")).hexdigest(), "fingerprint": mark.tobytes().hex(),
            "edited_fingerprint": edited_mark.tobytes().hex(), "near_edited": likeness(mark, edited_mark), "near_next": likeness(mark, following_mark),
            "part": None, "end": None, "text": None,
        }

    result = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}

    def batch_of(rows: list[dict], schema: str) -> pa.RecordBatch:
        fields = [f.split() for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[t]) for n, t in fields], names=[n for n, _ in fields])

    wide = f"{result}, part int, end string, text string"

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, edges = TaskContext.get().partitionId(), None, []
        edge = lambda i, text, end: dict.fromkeys((f.split()[0] for f in wide.split(", "))) | {"doc_id": i, "part": part, "end": end, "text": text}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small_batches(batches, 128):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = unpack(text).decode("utf-8")
                mark = sketch(text, k=k, tuples=tuples, length=length)
                if held is None:
                    edges.append(edge(doc_id, text, "first"))
                else:
                    rows.append(row(*held, text, mark))
                held = (doc_id, text, mark)
            yield batch_of(rows, wide)
        if held is not None:
            yield batch_of([*edges, edge(held[0], held[1], "last")], wide)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in small_batches(batches):
            texts = [pack((t or "").encode("utf-8", "replace")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc_id", "tie", "packed"])

    # texts are exchanged and sorted compressed, which halves what executors hold
    ranges = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) tie", "text").mapInArrow(packed, "doc_id long, tie long, packed binary")
    dealt = ranges.repartitionByRange(F.col("doc_id").desc_nulls_last(), F.col("tie")).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "tie").select("doc_id", "packed")
    found = written(dealt.mapInArrow(neighbours, wide), "fingerprints")
    # two rows for each task: its numbers pass through one window, its texts don't
    lasts = found.where("end = 'last'").select("part", "doc_id", "text")
    firsts = found.where("end = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    parts = found.where("end = 'last'").select(F.col("part").alias("p"))
    least = parts.agg(F.min("p").alias("least"))
    following = parts.withColumn("q", F.lead("p").over(Window.orderBy("p"))).crossJoin(F.broadcast(least)).select("p", F.coalesce("q", "least").alias("q"))
    pairs = lasts.join(following, lasts.part == following.p).join(firsts, F.col("q") == firsts.next_part).select("doc_id", "text", "following")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda t: sketch(t, k=k, tuples=tuples, length=length)
        for batch in small_batches(batches, 16):
            yield batch_of([row(i, t, of(t), n, of(n)) for i, t, n in zip(*(c.to_pylist() for c in batch.columns))], result)

    return found.where("end is null").drop("part", "end", "text").unionByName(pairs.mapInArrow(finished, result))
