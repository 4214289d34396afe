"""Packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wearstream.llm.common import small_batches
from wearstream.llm.tokens import Encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(lengths: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each length, with near-equal sums.

    The sorted lengths are dealt into partial partitions of k parts. The two with the largest imbalance are merged,
    largest part on smallest, until one is left. Ties go to the partition made first.
    """
    order = np.argsort(-lengths, kind="stable")
    padded = np.zeros(-(-len(lengths) // k) * k, np.int64)
    padded[: len(lengths)] = lengths[order]
    heap, made = [], 0
    for sums in padded.reshape(-1, k):  # a partition: its sums from large to small, and for each the items' rows
        heap.append((-(int(sums[0]) - int(sums[-1])), made, sums, np.full((1, k), made * k) + np.arange(k)))
        made += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, rows_a = heapq.heappop(heap)
        _, _, b, rows_b = heapq.heappop(heap)
        sums = a + b[::-1]
        by = np.argsort(-sums, kind="stable")
        sums, rows = sums[by], np.concatenate([rows_a, rows_b[:, ::-1]])[:, by]
        heapq.heappush(heap, (-(int(sums[0]) - int(sums[-1])), made, sums, rows))
        made += 1
    rows = heap[0][3]
    window = np.empty(padded.size, np.int64)
    window[rows.ravel()] = np.tile(np.arange(k), len(rows))
    out = np.empty(len(lengths), np.int64)
    out[order] = window[: len(lengths)]
    return out


def fitted(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows by differencing; their number rises until none exceeds the capacity."""
    k = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = differencing(lengths, k)
        if np.bincount(window, lengths, k).max() <= capacity:
            return window, k
        k += max(1, k // 500)


def pack_documents(docs: DataFrame, *, capacity: int = 2048, piece_tokens: int = 512, group_windows: int = 1024, end_id: int = 1, ranks_path: str | None = None) -> DataFrame:
    """Packs all documents' ids into sequences of at most capacity tokens.

    Each document's ids, then end_id, are cut: whole windows of capacity tokens make sequences of their own, the rest
    is cut into pieces of at most piece_tokens. As a task reads its documents, each group of about group_windows
    windows of pieces is packed at once, so memory is bounded and nothing is shuffled; a task that runs again gives
    the same rows. sequence_id is the task's number and a count within it, so over rows sorted into ranges it follows
    their order up to one group. Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A null text is empty: its one piece is the end id. Repeated rows and ids are packed each; a null doc_id is
    kept; an empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks_path).ids_bytes
        sequence = TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        loose: list[tuple] = []  # doc_id, start, length, crc, doc_tokens
        loose_tokens, full = 0, []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names=names)

        def packed() -> pa.RecordBatch:
            nonlocal sequence, loose, loose_tokens
            lengths = np.array([p[2] for p in loose], np.int64)
            window, k = fitted(lengths, capacity)
            rows, filled = [], [0] * k
            for i in np.argsort(window, kind="stable"):
                w = window[i]
                rows.append((*loose[i], sequence + int(w), filled[w]))
                filled[w] += loose[i][2]
            sequence += k
            loose, loose_tokens = [], 0
            return table(rows)

        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "", end_id)
                n, at = len(ids) // 4, 0
                while n - at >= capacity:
                    full.append((doc_id, at, capacity, zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n, sequence, 0))
                    sequence += 1
                    at += capacity
                while at < n:
                    size = min(piece_tokens, n - at)
                    loose.append((doc_id, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
                    loose_tokens += size
                    at += size
                if loose_tokens >= group_windows * capacity:
                    yield packed()
            if full:
                yield table(full)
                full = []
        if loose:
            yield packed()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
