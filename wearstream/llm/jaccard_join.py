"""N-gram Jaccard join: blocks by pigeonhole signatures, in each a size-aware heavy-light join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearstream.llm.common import Held, components, hashed_words, marked_bits, mix64, odd_constants, perhaps_in, removed, small_batches, window_hashes, written

#: Sizes from CLASS_RATIO ** c up to the next power are class c.
CLASS_RATIO = 1.3
#: Signatures that one group of the exchange holds on average (16 bytes each), and those that a task packs at a time.
BUCKET_SIGNATURES = 1 << 19
PACKED_SIGNATURES = 1 << 18
#: What one subset costs in the light join, in entries of an inverted list.
SUBSET_STEPS = 50


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence where it has fewer words; empty without words."""
    words = hashed_words(text, lower=True)
    if 0 < len(words) < size:
        return window_hashes(words, len(words), seed=1000 * len(words))
    return np.unique(window_hashes(words, size))


def set_key_of(s: np.ndarray) -> int:
    """A set's 64-bit hash."""
    return int(mix64(s ^ np.uint64(len(s))).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0


def class_floor(c: int) -> int:
    return int(np.ceil(CLASS_RATIO**c - 1e-9))


def class_of(n: int) -> int:
    c = int(np.log(n) / np.log(CLASS_RATIO))
    while class_floor(c + 1) <= n:
        c += 1
    while class_floor(c) > n:
        c -= 1
    return c


def unlike(n: int, percent: int) -> int:
    """The most elements by which a set of size n and one no smaller may differ and be linked: 100 (u - d) >= percent u."""
    largest = 100 * n // percent
    return (100 - percent) * largest // 100


def classes_of(n: int, percent: int) -> list[int]:
    """A set's own size class, and the lower ones from which a smaller partner may come."""
    own = class_of(n)
    return [c for c in range(own, -1, -1) if 100 * (class_floor(c + 1) - 1) >= percent * n]


@cache
def parts_of(c: int, percent: int) -> tuple[int, int]:
    """How many parts the sets of a class are split into, and how many of those a linked pair needs to be sure of an equal one.

    There are some more than needed, so that hardly a set has too many empty ones.
    """
    n, need = class_floor(c), unlike(class_floor(c + 1) - 1, percent) + 1
    parts = need
    while parts < 2 * need + 4 and parts - (empty := parts * np.exp(-n / parts)) - 2 * np.sqrt(empty) < need:
        parts += 1
    return parts, need


def signatures(s: np.ndarray, percent: int, frequent: Held | None = None) -> dict[int, np.ndarray]:
    """By size class, hashes such that linked sets share one in the class of the smaller.

    Two sets whose smaller one is in the class differ by less than the needed number of parts, to which elements belong by
    their hashes; so do their elements that aren't frequent. If as many parts as that have such elements in one of the two sets,
    one of those parts is equal. A set that fills fewer has signatures of the parts of all its elements besides, by which two
    such sets meet: of the filled ones if those are enough, else of the empty parts too, which unlike sets share.
    """
    out = {}
    rare = np.delete(s, frequent.places(s)[0]) if frequent is not None else s
    for c in classes_of(len(s), percent):
        parts, need = parts_of(c, percent)
        salt = odd_constants(1, 31 * c)[0]

        def hashes(elements: np.ndarray, enough: int) -> tuple[np.ndarray, int]:
            part = ((mix64(elements ^ salt) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part, mix64(elements + salt))
            filled = np.unique(part)
            at = filled if len(filled) >= enough else np.arange(parts)
            return mix64(sums[at] + mix64(at.astype(np.uint64) * salt + np.uint64(c + 1))), len(filled)

        out[c], filled = hashes(rare, 0)
        if filled < need:
            out[c] = np.union1d(out[c], hashes(s, need)[0])
    return out


def vertex(key: int, c: int) -> int:
    """The 64-bit hash that stands for a set in a size class."""
    return int(mix64(np.array([key], np.int64).view(np.uint64) + odd_constants(1, 977 + c)).view(np.int64)[0])


def packed_signatures(by_set: dict[int, np.ndarray], buckets: int) -> pa.RecordBatch:
    """One row for each bucket: its sorted signatures and the vertices that they are from, 8 bytes each."""
    keys = np.repeat(np.array(list(by_set), np.int64), [len(s) for s in by_set.values()])
    sigs = np.concatenate(list(by_set.values()))
    order = np.argsort(sigs)
    sigs, keys = sigs[order], keys[order]
    bucket = ((sigs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    begin = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
    spans = list(zip(begin, [*begin[1:], len(sigs)]))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[begin].astype(np.int64)), pa.array([sigs[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([keys[i:j].tobytes() for i, j in spans], pa.binary())],
        names=["bucket", "sigs", "set_keys"],
    )


def stars_of(bucket: pa.Table) -> pa.Table:
    """A star for each signature that several sets have: its first set with each of the others, each pair once."""
    sigs, keys = (np.frombuffer(b"".join(bucket.column(c).to_pylist()), kind) for c, kind in (("sigs", np.uint64), ("set_keys", np.int64)))
    order = np.lexsort((keys, sigs))
    sigs, keys = sigs[order], keys[order]
    begin = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    first = np.repeat(keys[begin], np.diff(begin, append=len(sigs)))
    other = first != keys
    pairs = np.unique(np.stack([first[other], keys[other]], axis=1), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def linked(common: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def boundary(sizes: np.ndarray, percent: int, mean_scan: float) -> int:
    """The largest size up to which enumerating subsets costs less than scanning inverted lists.

    A set of size n meets its partners in subsets of the least overlap a partner needs; there are at most
    comb(n, d) of those for every d it may lose, each as dear as SUBSET_STEPS entries of a list. A scan reads n lists
    of the mean length. Sets that may lose nothing are always light.
    """
    best = 0
    for n in range(1, int(sizes.max(initial=0)) + 1):
        lost = n - least_overlap(n, percent)
        if lost and SUBSET_STEPS * sum(comb(n, d) for d in range(lost + 1)) > n * (1 + mean_scan):
            break
        best = n
    return best


def least_overlap(n: int, percent: int) -> int:
    """The fewest elements that a set of size n shares with any linked set, whose size is then as small as it can be."""
    return -(-percent * n // 100)


@cache
def losses(n: int, d: int) -> np.ndarray:
    """One row for each way of leaving out d of n elements."""
    return np.array(list(combinations(range(n), d)), np.int64).reshape(comb(n, d), d)


def tally(lists: np.ndarray, begin: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """How often each of n sets is in the given lists, read at most 2 ** 20 entries at a time."""
    out = np.zeros(n, np.int64)
    step = max(1, (1 << 20) // max(n, 1))
    for k in range(0, len(begin), step):
        b, c = begin[k : k + step], count[k : k + step]
        at = np.repeat(b - (np.cumsum(c) - c), c) + np.arange(c.sum())
        out += np.bincount(lists[at], minlength=n)
    return out


def heavy_light(sets: list[np.ndarray], cross: np.ndarray | None, percent: int, guest: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """All links of the sets, each once, as a set and its partners; with cross only those between its two sides, and none
    between two guests.

    Light pairs meet in subsets of least overlap or more, and the largest that they share is what they have in common.
    A heavy set scans the inverted lists of its elements, counting what it shares with all sets at once; of an element
    that most sets have, the list of those without it is scanned and subtracted.
    """
    many = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    guest = np.zeros(many, bool) if guest is None else guest
    owner = np.repeat(np.arange(many), sizes)
    _, token, count = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    dense = 2 * count > many
    place = np.cumsum(dense) - 1
    without = np.ones((int(dense.sum()), many), bool)  # at most twice as many as there are elements
    without[place[token[dense[token]]], owner[dense[token]]] = False
    absent = np.nonzero(without)[1]
    absent_count = many - count[dense]
    absent_begin = np.cumsum(absent_count) - absent_count
    lists, begin = owner[np.argsort(token, kind="stable")], np.cumsum(count) - count
    limit = boundary(sizes, percent, float(np.minimum(count, many - count)[token].mean()) if len(token) else 0.0)
    light = sizes <= limit
    at = np.concatenate([[0], np.cumsum(sizes)])

    subsets: dict[tuple[int, int], np.ndarray] = {}  # by a light set and how many elements it loses
    for i in np.flatnonzero(light & (sizes > 0)):
        h = mix64(sets[i])
        for d in range(int(sizes[i]) - least_overlap(int(sizes[i]), percent) + 1):
            subsets[int(i), d] = h.sum(dtype=np.uint64) - h[losses(len(h), d)].sum(axis=1, dtype=np.uint64)
    keys = np.concatenate([np.empty(0, np.uint64), *subsets.values()])
    holder = np.repeat(np.array([i for i, _ in subsets], np.int64), [len(x) for x in subsets.values()])
    order = np.argsort(keys, kind="stable")
    keys, holder = keys[order], holder[order]

    before = np.arange(many)
    for i, s in enumerate(sets):
        if light[i]:
            shared = np.zeros(many, np.int64)
            for d in range(len(s) - least_overlap(len(s), percent), -1, -1):  # larger subsets come last
                if (i, d) in subsets:
                    a, z = np.searchsorted(keys, subsets[i, d]), np.searchsorted(keys, subsets[i, d], "right")
                    shared[tally(holder, a, z - a, many) > 0] = len(s) - d
            ok = light & (before < i)
        else:
            t = token[at[i] : at[i + 1]]
            most = dense[t]
            shared = tally(lists, begin[t[~most]], count[t[~most]], many)
            shared += int(most.sum()) - tally(absent, absent_begin[place[t[most]]], absent_count[place[t[most]]], many)
            # heavy pairs are taken once, from the later one; heavy with light always from the heavy one
            ok = (before < i) | light
        ok = ok & (shared > 0) & linked(shared, len(s), sizes, percent)
        ok[i] = False
        if guest[i]:
            ok &= ~guest
        if cross is not None:
            ok &= cross != cross[i]
        if ok.any():
            yield i, np.flatnonzero(ok)


def forest(sets: list[np.ndarray], ids: np.ndarray, cross: np.ndarray | None, percent: int, guest: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that keep all of the sets' components, and each set's number of links."""
    label, kept, links = np.arange(len(sets)), [], np.zeros(len(sets), np.int64)
    for i, others in heavy_light(sets, cross, percent, guest):
        links[i] += len(others)
        links[others] += 1
        other = others[label[others] != label[i]]
        if len(other):
            old, first = np.unique(label[other], return_index=True)
            kept += [(int(ids[min(i, j)]), int(ids[max(i, j)])) for j in other[first]]
            label[np.isin(label, old)] = label[i]
    return kept, links


def frequent_shingles(texts: DataFrame, size: int, one_in: int, least: int, most: int) -> Held:
    """Shingles that at least `least` different texts of one in one_in have, at most `most` of them.

    Only by which signatures sets meet depends on them, never the result.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found, times = np.unique(np.concatenate([np.empty(0, np.uint64), *(shingles(t, size) for t in batch.column(0).to_pylist())]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], names=["hash", "times"])

    sample = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).distinct().mapInArrow(counts, "hash long, times long")
    found = sample.groupBy("hash").agg(F.sum("times").alias("times")).where(F.col("times") >= least)
    return Held(np.array([r[0] for r in found.orderBy(F.desc("times"), "hash").limit(most).select("hash").collect()], np.int64).view(np.uint64))


def jaccard_groups(
    docs: DataFrame, *, size: int = 5, percent: int = 80, tile: int = 2000, one_in: int = 32, least: int = 6, most: int = 1 << 16, round_sets: int = 100_000
) -> DataFrame:
    """Every document with its set's size, its component under links of Jaccard >= percent / 100, and its links.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), n_links (different texts' sets linked with the
    document's), and the hashes text_key and set_key of its text and set. Steps: equal sets become one representative; in each size class, representatives that share a
    pigeonhole signature form blocks, and no link whose smaller set is of the class leaves a block (larger sets are guests
    there); each block is joined by size-aware heavy-light join, in tiles of at most
    2 * tile sets where it is larger; links that join components are kept, one forest per tile. Shingles that a sample
    (one text in one_in) finds in many texts don't count for a signature, or each passage that texts have in common would
    chain them to one block; sets of hardly anything else have signatures of all their shingles too.

    A null or wordless text has n_shingles 0, is linked with nothing and is its own component; an id repeated with
    different texts keeps a row and a component for each text; a null doc_id is left out, as it can't name a component; an empty table gives no rows; other columns aren't read. Texts are whole.
    """

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            keys = pa.array([set_key_of(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), keys], names=["doc_id", "text_key", "n", "set_key"])

    texts = docs.where("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "text")
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    members = written(keyed.mapInArrow(sets_of, "doc_id long, text_key long, n long, set_key long"), "members")
    reps = written(members.where("n > 0").groupBy("set_key", "n").agg(F.min("doc_id").alias("rep")), "reps")

    # signatures go by their leading bits, packed into one row for each bucket and handful of texts
    expected = (members.agg(F.sum("n")).first()[0] or 0) // 2
    buckets = 1 + expected // BUCKET_SIGNATURES

    def dealt_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # by vertex, so that a task's copies of a text count once
        count = 0
        for batch in small_batches(batches, 128):
            for text in batch.column(1).to_pylist():
                s = shingles(text, size)
                key = set_key_of(s)
                if len(s) and vertex(key, class_of(len(s))) not in held:
                    found = {vertex(key, c): sigs for c, sigs in signatures(s, percent, frequent).items()}
                    held |= found
                    count += sum(map(len, found.values()))
                if count >= PACKED_SIGNATURES:
                    yield packed_signatures(held, buckets)
                    held, count = {}, 0
        if held:
            yield packed_signatures(held, buckets)

    frequent = frequent_shingles(texts, size, one_in, least, most)
    packed = texts.mapInArrow(dealt_signatures, "bucket long, sigs binary, set_keys binary")
    stars = written(packed.groupBy("bucket").applyInArrow(stars_of, "a long, b long").distinct(), "stars")
    blocks = components(stars).select(F.col("node").alias("vertex"), F.col("component").alias("block"))

    def vertices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (rep, key, vertex(key, c), c < class_of(n)) for rep, key, n in zip(*(batch.column(x).to_pylist() for x in ("rep", "set_key", "n"))) for c in classes_of(n, percent)
            ]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["rep", "set_key", "vertex", "guest"])

    vertices = reps.mapInArrow(vertices_of, "rep long, set_key long, vertex long, guest boolean")
    rows = written(vertices.join(blocks, "vertex").select("rep", "set_key", "block", "guest"), "blocks")
    # a block's sets are dealt into parts of about tile sets; every pair of parts is one task's group
    parts = rows.groupBy("block").agg(F.count("*").alias("count"), F.min("guest").alias("guests")).where("count > 1 and not guests").select("block", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    dealt = written(rows.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int")), "dealt")
    # texts travel, as they are shorter than their sets; those of no such block are left out before the exchange, but for few
    needed = perhaps_in(texts, "doc_id", written(marked_bits(dealt, "rep"), "block-ids"), "needed").where("needed").drop("needed")
    chosen = dealt.hint("merge").join(needed, F.col("rep") == F.col("doc_id")).select("block", "part", "parts", "guest", "rep", "set_key", "text")
    # a block's texts travel once for each of its parts, so their tiles take turns: no round sends more texts than there are, or round_sets
    rounds = 1 + int((dealt.agg(F.sum("parts")).first()[0] or 0) // max(members.count(), round_sets))
    chosen = written(chosen, "block-texts") if rounds > 1 else chosen

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = {}, None  # (rep, set_key): (part, guest, elements)

        def flush() -> pa.RecordBatch:
            ids = np.array([rep for rep, _ in group])
            cross = np.array([part for part, _, _ in group.values()]) if at[1] != at[2] else None
            kept, links = forest([s for _, _, s in group.values()], ids, cross, percent, np.array([g for _, g, _ in group.values()]))
            a, b, n = [k[0] for k in kept], [k[1] for k in kept], [0] * len(kept)
            some = np.flatnonzero(links)
            a, b, n = a + ids[some].tolist(), b + ids[some].tolist(), n + links[some].tolist()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            for block, low, high, part, guest, rep, key, text in zip(*(batch.column(c) for c in range(batch.num_columns))):
                here = (block.as_py(), low.as_py(), high.as_py())
                if here != at:
                    if len(group) > 1:
                        yield flush()
                    group, at = {}, here
                s = shingles(text.as_py(), size)
                if set_key_of(s) == key.as_py():  # a repeated id's other texts have other sets
                    group[rep.as_py(), key.as_py()] = (part.as_py(), guest.as_py(), s)
        if len(group) > 1:
            yield flush()

    def links_of(turn: int) -> DataFrame:
        its = F.expr(f"filter(sequence(0, parts - 1), x -> pmod(xxhash64(block, least(part, x), greatest(part, x)), {rounds}) = {turn})")
        spread = chosen.withColumn("other", F.explode(its))
        tiles = spread.select("block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "guest", "rep", "set_key", "text")
        grouped = tiles.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high", "rep", "set_key")
        return written(grouped.mapInArrow(joined, "a long, b long, n long"), "links")

    edges = reduce(DataFrame.unionByName, [links_of(turn) for turn in range(rounds)])
    if rounds > 1:
        removed(chosen)
    found = components(edges.where("a <> b").select("a", "b"))
    links = edges.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    named = reps.join(found, reps.rep == found.node, "left").join(links, "rep", "left").select(
        F.col("set_key").alias("rep_key"), F.col("n").alias("rep_n"), F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    named = written(named, "named")
    same = (F.col("set_key") == F.col("rep_key")) & (F.col("n") == F.col("rep_n"))
    return members.join(named, same, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_key", "set_key"
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents, with their own columns, one row of each component: of those with its smallest doc_id.

    Of several texts with one id and equal sets, the one with the smallest hash stays; of equal rows, one. An id with
    unlike texts has a row in each of their components, and each is judged by itself. Rows without words or with a null
    doc_id are no copies of anything and all stay.
    """
    groups = written(jaccard_groups(docs, **options).where("n_shingles > 0"), "groups")
    mine = groups.where("component_id = doc_id").groupBy(F.col("doc_id").alias("d"), F.col("set_key").alias("k")).agg(F.min("text_key").alias("first_text"))
    judged = groups.join(mine, (F.col("doc_id") == F.col("d")) & (F.col("set_key") == F.col("k")), "left")
    gone = (F.col("component_id") < F.col("doc_id")) | (F.col("text_key") != F.col("first_text"))
    fates = judged.groupBy(F.col("doc_id").alias("fate_id"), F.col("text_key").alias("fate_key")).agg(F.bool_or(gone).alias("gone"), F.count("*").alias("copies")).where("gone or copies > 1")
    fates = written(fates, "fates")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("id", F.col("row.doc_id").cast("long"))
    rows = perhaps_in(rows, "id", written(marked_bits(fates, "fate_id"), "fate-ids"), "touched")
    touched = rows.where("touched").withColumn("text_key", F.xxhash64("row.text"))
    same = (F.col("id") == F.col("fate_id")) & (F.col("text_key") == F.col("fate_key"))
    left = touched.join(fates, same, "left").where("gone is null or not gone")
    once = left.where("copies > 1").groupBy("id", "text_key").agg(F.any_value("row").alias("row"))
    out = rows.where("not touched").select("row").union(left.where("copies is null or copies = 1").select("row")).union(once.select("row"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
