"""Removal of repeated passages by prefix-partitioned suffix subtrees.

Every word of a text begins a suffix, of which the first k words count. The suffixes are dealt to groups by prefixes of
variable length: one word, lengthened word by word while a sample says that it begins more suffixes than a group may
hold. Groups are bundled to buckets, of which a task gets several and sorts one at a time, in which its groups' subtrees
are runs: a run of several suffixes that are equal to depth k is an internal node of that depth or deeper. All of its
suffixes but those of the smallest doc_id are repeats, and neighbouring ones join to the document's maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearstream.llm.common import Held, marked_bits, mix64, perhaps_in, small_batches, window_hashes, word_hashes, word_spans, written

#: What a task packs at a time.
PACKED_SUFFIXES = 1 << 20

#: A prefix counts in a batch of the sample if it is there so often; the more batches, the more suffixes this may hide.
LOCAL = 2

#: What a task has in memory at a time: Arrow, the JVM's buffer to Python and the sort each hold it, the sort several times.
SORTED_SUFFIXES = 1 << 19


def hashes_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "replace").split())


def groups_of(words: np.ndarray, k: int, longer: Held) -> np.ndarray:
    """The prefix of each suffix: the shortest that isn't among those to be lengthened; at most k words."""
    n = len(words) - k + 1
    out = window_hashes(words, 1)[:n]
    for p in range(2, k + 1):
        some, _ = longer.places(out)
        if not len(some):
            break
        out = out.copy()
        out[some] = window_hashes(words, p)[some]
    return out


def sampled(texts: DataFrame, k: int, one_in: int, group_suffixes: int, least: int, most: int) -> tuple[Held, Held, int]:
    """From one text in one_in: the prefixes to be lengthened, the windows that many texts hold, and how many suffixes there are.

    Only how a suffix is handled depends on them, never the result. Both tables have at most most entries.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 512):
            texts_words = [w for w in map(hashes_of, batch.column(1).to_pylist()) if len(w) >= k]
            windows = [np.unique(window_hashes(w, k)) for w in texts_words]
            out = [(0, *np.unique(np.concatenate(windows), return_counts=True))] if windows else []
            todo = [np.ones(len(w) - k + 1, bool) for w in texts_words]
            for p in range(1, k):  # a prefix's continuations count only where it is frequent itself
                hashes = [window_hashes(w, p)[: len(t)] for w, t in zip(texts_words, todo)]
                found, times = np.unique(np.concatenate([np.empty(0, np.uint64), *(h[t] for h, t in zip(hashes, todo))]), return_counts=True)
                found, times = found[times >= LOCAL], times[times >= LOCAL]
                if not len(found):
                    break
                out.append((1, found, times))
                todo = [t & np.isin(h, found) for h, t in zip(hashes, todo)]
            total = sum(len(w) - k + 1 for w in texts_words)
            out.append((2, np.zeros(1, np.uint64), np.array([total])))
            kind, found, times = (np.concatenate(x) for x in zip(*((np.full(len(h), i), h, n) for i, h, n in out)))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], names=["kind", "hash", "times"])

    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).mapInArrow(counts, "kind long, hash long, times long")
    found = sample.groupBy("kind", "hash").agg(F.sum("times").alias("times")).where(f"kind = 2 or (kind = 0 and times >= {least}) or (kind = 1 and times > {group_suffixes // one_in})")
    found = written(found, "suffix-sample")
    pick = lambda kind: found.where(f"kind = {kind}").orderBy(F.desc("times"), "hash").limit(most).select("hash").collect()
    table = lambda rows: Held(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    total = found.where("kind = 2").agg(F.sum("times")).first()[0] or 0
    return table(pick(1)), table(pick(0)), total * one_in


def bucket_of(groups: np.ndarray, buckets: int) -> np.ndarray:
    return (((mix64(groups) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def packed_suffixes(hashes: np.ndarray, bucket: np.ndarray, ids: np.ndarray, hot: Held) -> pa.RecordBatch:
    """One row for each bucket: its suffixes' hashes, 8 bytes each, and the steps between their ids, 4 bytes where they fit.

    Of a window that many texts hold only the smallest id goes.
    """
    some, at = hot.places(hashes)
    if len(some):
        least = np.full(len(hot.table), np.iinfo(np.int64).max)
        np.minimum.at(least, at, ids[some])
        which, first = np.unique(at, return_index=True)
        rest = np.ones(len(hashes), bool)
        rest[some] = False
        hashes, ids, bucket = np.r_[hashes[rest], hot.table[which]], np.r_[ids[rest], least[which]], np.r_[bucket[rest], bucket[some[first]]]
    order = np.lexsort((ids, bucket))
    hashes, ids, bucket = hashes[order], ids[order], bucket[order]
    del order
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    spans = list(zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)]))
    steps = [np.diff(ids[a:b], prepend=ids[a]) for a, b in spans]
    narrow = [x.astype(np.uint32) if 0 <= x.min() and x.max() < 1 << 32 else x for x in steps]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[begin].astype(np.int64)), pa.array(ids[begin]), pa.array([hashes[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([x.tobytes() for x in narrow], pa.binary())],
        names=["bucket", "base", "hashes", "steps"],
    )


HOT = -1


def subtrees(bucket: pa.Table, hot: Held, parts: int) -> pa.Table:
    """A bucket's nodes at depth k with suffixes of several ids: each larger id with its nodes' hashes, one row per part of ids.

    Of hot nodes, in a part of their own, the smallest ids.
    """
    hashes, ids = [], []
    for base, h, s in zip(bucket.column("base").to_pylist(), bucket.column("hashes").to_pylist(), bucket.column("steps").to_pylist()):
        hashes.append(np.frombuffer(h, np.uint64))
        ids.append(base + np.cumsum(np.frombuffer(s, np.uint32 if len(s) < len(h) else np.int64).astype(np.int64)))
    hashes, ids = np.concatenate(hashes), np.concatenate(ids)
    order = np.argsort(hashes)
    hashes, ids = hashes[order], ids[order]
    begin = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    size = np.diff(begin, append=len(hashes))
    least = np.minimum.reduceat(ids, begin)
    known = np.zeros(len(begin), bool)
    known[hot.places(hashes[begin])[0]] = True
    repeated = np.repeat((size > 1) & ~known, size)
    repeated[repeated] = ids[repeated] > np.repeat(least, size)[repeated]
    part = np.r_[np.full(known.sum(), HOT), (mix64(ids[repeated].view(np.uint64)) % np.uint64(parts)).astype(np.int64)]
    ids, hashes = np.r_[least[known], ids[repeated]], np.r_[hashes[begin[known]], hashes[repeated]]
    order = np.argsort(part, kind="stable")
    part, ids, hashes = part[order], ids[order], hashes[order]
    at = np.flatnonzero(np.diff(part, prepend=HOT - 1))
    spans = list(zip(at.tolist(), [*at[1:].tolist(), len(part)]))
    packed = lambda x: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())
    return pa.table([pa.array(part[at]), packed(ids), packed(hashes)], names=["part", "ids", "hashes"])


def by_id(part: pa.Table) -> pa.Table:
    """One row for each id of a part, with all its hashes."""
    ids, hashes = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("ids", np.int64), ("hashes", np.uint64)))
    order = np.argsort(ids, kind="stable")
    ids, hashes = ids[order], hashes[order]
    at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return pa.table([pa.array(ids[at]), pa.array([hashes[a:b].tobytes() for a, b in zip(at.tolist(), [*at[1:].tolist(), len(ids)])], pa.binary())], names=["id", "marks"])


def without(data: bytes, gone: np.ndarray, layout: bool) -> bytes:
    """The text's words that stay, joined by one space; or with the white space that follows each, and what precedes the first word."""
    if not layout:
        return b" ".join([w for w, g in zip(data.split(), gone.tolist()) if not g])
    starts, _ = word_spans(data)
    ends = [*starts[1:].tolist(), len(data)]
    return data[: starts[0]] + b"".join([data[a:b] for a, b, g in zip(starts.tolist(), ends, gone.tolist()) if not g])


def spans_of(gone: np.ndarray) -> list[dict]:
    """Runs of words that go: first word and number of words."""
    step = np.diff(np.r_[0, gone.astype(np.int8), 0])
    return [{"first": int(a), "words": int(b - a)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]


def remove_repeats(
    docs: DataFrame, *, k: int = 13, layout: bool = False, one_in: int = 32, least: int = 6, most: int = 1 << 16, group_suffixes: int = 1 << 17, bucket_suffixes: int = 1 << 21
) -> DataFrame:
    """Every document with its repeated words taken out: a column row (all input columns), n_words, n_removed, kept_text, repeats.

    A word goes if a window of k words that covers it also starts in a document with a smaller doc_id. kept_text is
    the kept words joined by one space or, with layout, with the white space that follows each in the text (a text that
    loses nothing is then as it was). repeats are the runs of words that went: first, words. A null or wordless text has
    no words and the empty kept_text (with layout its white space); rows with a null doc_id keep all words and remove
    none of others; rows that share a doc_id never remove each other's words; a text shorter than k words loses none;
    an empty table gives no rows. Texts are whole.

    A suffix travels as its first k words' 64-bit hash; two unequal windows would have to agree in it and fall into one
    bucket. A task is dealt about bucket_suffixes, in buckets of at most about SORTED_SUFFIXES of 16 bytes, which it holds
    one at a time and whose groups are at most about group_suffixes each as far as the sample tells; windows that many texts hold travel once per packed batch, and
    their smallest ids (at most most) reach every task. Rows without a repeat aren't exchanged, but for few.
    """
    texts = docs.where("doc_id is not null and text is not null").selectExpr("cast(doc_id as long) doc_id", "text")
    longer, hot, total = sampled(texts, k, one_in, group_suffixes, least, most)
    tasks, buckets = 1 + total // bucket_suffixes, 1 + total // min(bucket_suffixes, SORTED_SUFFIXES)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bucket, ids, lengths, count = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            all_ids, all_hashes = np.repeat(np.array(ids, np.int64), lengths), np.concatenate(hashes)
            hashes.clear()
            all_buckets = np.concatenate(bucket)
            for x in (bucket, ids, lengths):
                x.clear()
            return packed_suffixes(all_hashes, all_buckets, all_ids, hot)

        for batch in small_batches(batches, 256):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = hashes_of(text)
                if len(words) >= k:
                    windows = window_hashes(words, k)
                    hashes.append(windows)
                    bucket.append(bucket_of(groups_of(words, k, longer), buckets))
                    ids.append(doc_id)
                    lengths.append(len(windows))
                    count += len(windows)
                if count >= PACKED_SUFFIXES:
                    yield flush()
                    count = 0
        if ids:
            yield flush()

    dealt = texts.mapInArrow(suffixes, "bucket long, base long, hashes binary, steps binary")
    found = written(dealt.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lambda t: subtrees(t, hot, tasks), "part long, ids binary, hashes binary"), "nodes")
    firsts = found.where(f"part = {HOT}").select("ids", "hashes").collect()
    hot_hashes = np.frombuffer(b"".join(bytes(r["hashes"]) for r in firsts), np.uint64)
    hot_seen, hot_first = Held(hot_hashes), np.frombuffer(b"".join(bytes(r["ids"]) for r in firsts), np.int64)[np.argsort(hot_hashes)]
    marks = written(found.where("part >= 0").repartition(tasks, "part").groupBy("part").applyInArrow(by_id, "id long, marks binary"), "marks")

    place = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            n_words, n_gone, kept, repeats = [], [], [], []
            texts = batch.column(0).field(place).to_pylist()
            for doc_id, text, marked in zip(batch.column(1).to_pylist(), texts, batch.column(2).to_pylist()):
                data = (text or "").encode("utf-8", "replace")
                words = word_hashes(data.split())
                gone = np.zeros(len(words), bool)
                if doc_id is not None and len(words) >= k:
                    windows = window_hashes(words, k)
                    bad = np.isin(windows, np.frombuffer(marked, np.uint64)) if marked else np.zeros(len(windows), bool)
                    some, at = hot_seen.places(windows)
                    bad[some[hot_first[at] < doc_id]] = True
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[: len(bad)] += bad
                    edge[k : k + len(bad)] -= bad
                    gone = np.cumsum(edge)[:-1] > 0
                n_words.append(len(words))
                n_gone.append(int(gone.sum()))
                kept.append((data if layout and not n_gone[-1] else without(data, gone, layout)).decode("utf-8"))
                repeats.append(spans_of(gone) if n_gone[-1] else [])
            spans = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string()), pa.array(repeats, spans)],
                names=["row", "n_words", "n_removed", "kept_text", "repeats"],
            )

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("doc_id", F.col("row.doc_id").cast("long"))
    rows = perhaps_in(rows, "doc_id", written(marked_bits(marks, "id"), "marked-ids"), "touched")
    joined = rows.where("touched").select("row", "doc_id").join(marks.hint("merge"), F.col("doc_id") == F.col("id"), "left").select("row", "doc_id", "marks")
    both = joined.unionByName(rows.where("not touched").select("row", "doc_id", F.lit(None).cast("binary").alias("marks")))
    schema = both.select("row").selectExpr("row", "0L n_words", "0L n_removed", "'' kept_text", "cast(null as array<struct<first:long,words:long>>) repeats").schema
    return both.mapInArrow(cut, schema)  # the row holds the text, so it travels once
