"""The trie of conversations' prefixes by padded matrices of turn ids.

Distinct sequences of turn ids are dealt to shards by ranges. In a shard, `ordered` sorts them by lexsort over padded
blocks of columns; from the sorted rows, `shared_turns` takes masks of the columns in which neighbouring rows differ
and accumulates them by OR, so that a node starts wherever the accumulated mask is set; `merged` lays all cells out by
depth and aggregates every depth's nodes by reduceat, and subtrees, which are contiguous in order of (row, depth), by
running sums. Nodes that hold a shard's first or last row may go on in a neighbour, so only their paths, with what the
shard knows of each depth, go to a further round, which treats these paths as its rows; each round has few of them for
every shard of the last, and the last round is one shard that closes all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import reduce
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearstream.llm.common import mix64, odd_constants, small_batches, written

#: Cells (a turn of a sequence, and its root) of a shard, and of the smallest one that is split off to use more tasks.
SHARD_CELLS = 1 << 20
SPLIT_CELLS = 1 << 13
#: Columns of a padded block.
BLOCK = 16
#: Bytes of decimal ids in one row on the way to their hash.
PACKED_IDS = 1 << 16
EMPTY = np.frombuffer(sha256(b"").digest(), np.uint64)
MOST = np.iinfo(np.int64).max
SUMS = ("n", "kids", "leaves", "saved")


@dataclass
class Rows:
    """Sequences, of which row r has size[r] turns and size[r] + 1 cells, from begin[r] on; a cell is a row's node at a depth.

    turn and chars are the last turn's id and length (0 at the root). n, least, kids, leaves and saved hold what is known
    of a cell's node: members, smallest member, closed children, and leaves and savings below them. ends are the hashes of
    the members that end there, as four numbers, or zeros.
    """

    size: np.ndarray
    turn: np.ndarray
    chars: np.ndarray
    n: np.ndarray
    least: np.ndarray
    kids: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    ends: np.ndarray

    @property
    def begin(self) -> np.ndarray:
        return np.cumsum(self.size + 1) - (self.size + 1)

    def taken(self, order: np.ndarray) -> Rows:
        size = self.size[order]
        at = np.repeat(self.begin[order] - (np.cumsum(size + 1) - (size + 1)), size + 1) + np.arange(int((size + 1).sum()))
        return Rows(size, *(getattr(self, f.name)[at] for f in fields(self)[1:]))


def padded(rows: Rows, which: np.ndarray, block: int) -> np.ndarray:
    """A matrix of some rows' turn ids in a block of columns; missing turns come before all ids."""
    column = block * BLOCK + np.arange(BLOCK)
    there = column < rows.size[which, None]
    at = np.where(there, rows.begin[which, None] + 1 + column, 0)
    return np.where(there, rows.turn[at], np.iinfo(np.int64).min)


def ordered(rows: Rows) -> np.ndarray:
    """The rows in lexical order, a prefix first: block by block, in each only those that are equal so far."""
    order, block = np.arange(len(rows.size)), 0
    place, group = order, np.zeros(len(order), np.int64)  # places in order that aren't settled, and their groups
    while len(place):
        matrix = padded(rows, order[place], block)
        by = np.lexsort((np.minimum(rows.size[order[place]], (block + 1) * BLOCK + 1), *matrix.T[::-1], group))
        order[place], matrix = order[place[by]], matrix[by]
        more = rows.size[order[place]] > (block + 1) * BLOCK
        same = np.r_[False, (group[1:] == group[:-1]) & (matrix[1:] == matrix[:-1]).all(axis=1) & more[1:] & more[:-1]]
        tied = same | np.r_[same[1:], False]
        group = np.cumsum(~same)[tied]
        place, block = place[tied], block + 1
    return order


def shared_turns(rows: Rows) -> np.ndarray:
    """How many first turns each of the sorted rows has in common with the row before; -1 for the first row.

    A block's change masks, accumulated by OR, are set from the first changed column on.
    """
    out, left, block = np.full(len(rows.size), -1), np.arange(1, len(rows.size)), 0
    out[1:] = 0
    while len(left):
        column = block * BLOCK + np.arange(BLOCK)
        change = padded(rows, left, block) != padded(rows, left - 1, block)
        change |= column >= np.minimum(rows.size[left], rows.size[left - 1])[:, None]
        same = ~np.logical_or.accumulate(change, axis=1)
        out[left] += same.sum(axis=1)
        left, block = left[same[:, -1]], block + 1
    return out


def keys_of(rows: Rows, depth: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each cell's prefix."""
    each = mix64(rows.turn.view(np.uint64)) * odd_constants(int(depth.max(initial=0)) + 1, 611953)[depth]
    each[depth == 0] = 0
    sums = np.cumsum(each)
    begin = rows.begin
    before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
    return mix64(sums - np.repeat(before, rows.size + 1) + depth.astype(np.uint64)).view(np.int64)


def merged(rows: Rows, last: bool) -> tuple[dict[str, np.ndarray], Rows | None]:
    """Some sequences' closed nodes as columns, and the rows that carry on those that may go on elsewhere (last: none do)."""
    rows = rows.taken(ordered(rows))
    many, begin = len(rows.size), rows.begin
    row = np.repeat(np.arange(many), rows.size + 1)
    depth = np.arange(len(row)) - begin[row]
    common = shared_turns(rows)
    cells = np.argsort(depth, kind="stable")  # by depth, then row
    first = common[row[cells]] < depth[cells]
    start = np.flatnonzero(first)
    node = np.empty(len(row), np.int64)
    node[cells] = np.cumsum(first) - 1
    head = cells[start]  # each node's cell in its first row
    span = np.diff(start, append=len(cells))
    top, deep = row[head], depth[head]
    parent = np.where(deep > 0, node[head - 1], -1)
    total = {c: np.add.reduceat(getattr(rows, c)[cells], start) for c in SUMS}
    least = np.minimum.reduceat(rows.least[cells], start)
    end = np.maximum.reduceat(np.where(rows.ends[cells].any(axis=1), cells, -1), start)
    ends = np.where(end[:, None] >= 0, rows.ends[end], np.uint64(0))

    paths = [np.empty(0, np.int64)] if last else [node[: rows.size[0] + 1], node[begin[-1] :]]
    open_ = np.zeros(len(head), bool)
    open_[np.concatenate(paths)] = True
    up = parent[~open_ & (parent >= 0)]
    kids = total["kids"] + np.bincount(up, minlength=len(head))
    # subtrees are contiguous in order of (first row, depth), in which closed nodes have closed ones only
    nodes_before = np.r_[0, np.cumsum(rows.size - common)]
    place = nodes_before[top] + deep - common[top] - 1
    order = np.argsort(place)
    sums = {}
    for c, own in (("leaves", kids == 0), ("saved", (total["n"] - 1) * rows.chars[head])):
        running = np.r_[0, np.cumsum(np.where(open_, 0, total[c] + own)[order])]
        sums[c] = np.where(open_, total[c], running[nodes_before[top + span]] - running[place])
    keys = keys_of(rows, depth)
    shut = np.flatnonzero(~open_)
    above = parent[shut]
    known = (above >= 0) & ~open_[above]
    out = {
        "conv_id": least[shut], "depth": deep[shut], "parent_conv_id": (least[above], ~known), "n_convs": total["n"][shut], "n_children": kids[shut],
        "n_leaves": sums["leaves"][shut], "saved_tokens": sums["saved"][shut], "ends": np.where(end[shut, None] >= 0, ends[shut], EMPTY),
        "key": keys[head[shut]], "parent_key": (keys[head[above]], known | (above < 0)),
    }
    if last:
        return out, None
    for c in ("leaves", "saved"):  # of closed children; what lies below them is in their sums
        np.add.at(total[c], up, sums[c][~open_ & (parent >= 0)])
    total["kids"] = kids
    edge = rows.taken(np.array([0, many - 1][: min(many, 2)]))
    at = np.concatenate([node[: rows.size[0] + 1], node[begin[-1] :]])[: len(edge.turn)]
    fresh = np.ones(len(at), bool)
    if many > 1:  # what both paths share counts once
        fresh[rows.size[0] + 1 :][: int(common[1:].min()) + 1] = False
    values = {c: np.where(fresh, total[c][at], 0) for c in SUMS}
    return out, Rows(edge.size, edge.turn, edge.chars, **values, least=np.where(fresh, least[at], MOST), ends=np.where(fresh[:, None], ends[at], np.uint64(0)))


PATHS = "ids array<long>, cells binary, ends binary"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, key long, parent_key long"


def batch_of(out: dict, paths: Rows | None) -> pa.RecordBatch:
    """Closed nodes, then the paths that go on. A column is an array, or one and where it is null."""
    n = len(out["conv_id"])
    numbers = lambda v: pa.array(v[0], pa.int64(), mask=v[1]) if isinstance(v, tuple) else pa.array(v, pa.int64())
    columns = [pa.array([x.tobytes() for x in v], pa.binary()) if c == "ends" else numbers(v) for c, v in out.items()]
    more: list[list] = [[], [], []]
    if paths is not None:
        for a, size in zip(paths.begin.tolist(), paths.size.tolist()):
            part = slice(a, a + size + 1)
            more[0].append(paths.turn[a + 1 : a + size + 1])
            more[1].append(np.stack([getattr(paths, c)[part] for c in ("chars", "n", "least", "kids", "leaves", "saved")]).tobytes())
            more[2].append(paths.ends[part].tobytes())
    k = len(more[0])
    columns = [pa.concat_arrays([c, pa.nulls(k, c.type)]) for c in columns]
    kinds = (pa.list_(pa.int64()), pa.binary(), pa.binary())
    tail = [pa.concat_arrays([pa.nulls(n, t), pa.array(x, t)]) for x, t in zip(more, kinds)]
    return pa.RecordBatch.from_arrays(columns + tail, names=[*out, "ids", "path_cells", "path_ends"])


def rows_of(ids: list[np.ndarray], cells: list[bytes], ends: list[bytes]) -> Rows:
    size = np.array([len(x) for x in ids], np.int64)
    turn = np.concatenate([np.r_[0, x] for x in ids]).astype(np.int64)
    values = np.concatenate([np.frombuffer(c, np.int64).reshape(6, -1) for c in cells], axis=1)
    chars, n, least, kids, leaves, saved = values
    return Rows(size, turn, chars, n, least, kids, leaves, saved, np.frombuffer(b"".join(ends), np.uint64).reshape(-1, 4))


def closed(paths: DataFrame, last: bool) -> DataFrame:
    """The nodes and the remaining paths of each partition's paths (ids, cells, ends)."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, cells, ends = [], [], []
        for batch in batches:
            ids += list(batch.column(0).to_numpy(zero_copy_only=False))
            cells += batch.column(1).to_pylist()
            ends += batch.column(2).to_pylist()
        if ids:
            yield batch_of(*merged(rows_of(ids, cells, ends), last))

    return paths.mapInArrow(shard, f"{NODES}, ids array<long>, path_cells binary, path_ends binary")


def prefix_nodes(sequences: DataFrame, *, shard_cells: int = SHARD_CELLS, split_cells: int = SPLIT_CELLS) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, ids array<long>, chars binary: an int64 for each turn).

    conv_ids must be distinct. A node's columns are conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256, as `conversation_trie` says. Equal turns have equal ids.
    """
    keyed = sequences.select("conv_id", "ids", "chars", F.xxhash64("ids").alias("a"), F.hash("ids").cast("long").alias("b"), F.size("ids").cast("long").alias("c"))
    keyed = written(keyed, "sequences")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted ids of equal sequences, packed as text."""
        held, key = [], None
        row = lambda: (*key, held[0], len(held), ",".join(map(str, held)))
        for batch in batches:
            out = []
            for *here, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != here or 20 * len(held) > PACKED_IDS:
                    if held:
                        out.append(row())
                    held, key = [], here
                held.append(conv)
            yield named_batch(out, CHUNKS)
        yield named_batch([row()] if held else [], CHUNKS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hash of each sequence's ids, chunk after chunk."""
        key, state, first, many = None, None, None, 0
        out: list[tuple] = []
        for batch in batches:
            for a, b, c, least, count, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if key != (a, b, c):
                    if key:
                        out.append((first, many, state.digest()))
                    key, state, first, many = (a, b, c), sha256(), least, 0
                state.update(((b"," if many else b"") + text.encode()))
                many += count
            yield named_batch(out, ENDS)
            out = []
        yield named_batch([(first, many, state.digest())] if key else [], ENDS)

    order = ["a", "b", "c", "conv_id"]
    packed = keyed.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, CHUNKS)
    ends = packed.repartition("a", "b", "c").sortWithinPartitions("a", "b", "c", "first").mapInArrow(hashed, ENDS)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct sequences as paths, of which every depth has the same members."""
        for batch in batches:
            ids, cells, tails = batch.column(0), [], []
            for size, chars, least, many, end in zip(ids.value_lengths().to_pylist(), *(batch.column(i).to_pylist() for i in range(1, 5))):
                table = np.zeros((6, size + 1), np.int64)
                table[0, 1:], table[1], table[2] = np.frombuffer(chars, np.int64), many, least
                cells.append(table.tobytes())
                tails.append(b"\x00" * 32 * size + end)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cells, pa.binary()), pa.array(tails, pa.binary())], names=["ids", "cells", "ends"])

    distinct = written(ends.join(keyed, F.col("first") == F.col("conv_id")).select("ids", "chars", "first", "many", "ends"), "distinct")
    paths, rounds = distinct.mapInArrow(opened, PATHS), []
    count, cells = distinct.agg(F.count("*"), F.sum(F.size("ids") + F.lit(1))).first()
    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while not rounds or count:
        last = bool(rounds) and (cells <= shard_cells or count <= 4)
        shards = min(max(1 + (cells or 0) // shard_cells, min(tasks, 1 + (cells or 0) // split_cells)), 1 + (count or 0) // 4)
        dealt = paths.repartition(1) if last else paths.repartitionByRange(shards, "ids")
        done = written(closed(dealt, last), "nodes")
        rounds.append(done.where("conv_id is not null"))
        left = done.where("ids is not null")
        count, cells = left.agg(F.count("*"), F.sum(F.size("ids") + F.lit(1))).first()
        paths = left.select("ids", F.col("path_cells").alias("cells"), F.col("path_ends").alias("ends"))
    nodes = reduce(DataFrame.union, [r.select(*[c.split()[0] for c in NODES.split(", ")]) for r in rounds])
    later = reduce(DataFrame.union, [r.select(F.col("key").alias("k"), F.col("conv_id").alias("found")) for r in rounds[1:]] or [rounds[0].where("false").select(F.col("key").alias("k"), F.col("conv_id").alias("found"))])
    asked = nodes.where("parent_key is not null").join(later, F.col("parent_key") == F.col("k")).withColumn("parent_conv_id", F.col("found"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    both = nodes.where("parent_key is null").select(*names, "ends").union(asked.select(*names, "ends"))
    return both.select(*names, F.lower(F.hex("ends")).alias("ends_sha256"))


CHUNKS = "a long, b long, c long, first long, many long, text string"
ENDS = "first long, many long, ends binary"


def named_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    values = list(zip(*rows)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(values, columns)], names=[c for c, _ in columns])


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """Each conversation's turns in order (null first; ties by role, then text): conv_id, ids, chars.

    A turn's id is a 64-bit hash of role and text, nulls being empty. Rows are sorted on disk, without their texts from
    there on; a conversation becomes one row of 16 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"id": F.xxhash64("role", "text"), "chars": F.char_length("text").cast("long")})
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "id", "chars")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, chars = None, [], []

        def row(convs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in convs], pa.int64()), pa.array([i for _, i, _ in convs], pa.list_(pa.int64())), pa.array([x for *_, x in convs], pa.binary())], names=["conv_id", "ids", "chars"])

        for batch in batches:
            conv, new_ids, new_chars = (batch.column(i).to_numpy() for i in range(3))
            cut, out = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]) if len(conv) else [], []
            for a, b in zip(cut, [*cut[1:], len(conv)]):
                if key is not None and key != conv[a]:
                    out.append((key, np.concatenate(ids), np.concatenate(chars).tobytes()))
                    ids, chars = [], []
                key = int(conv[a])
                ids.append(new_ids[a:b])
                chars.append(new_chars[a:b])
            if out:
                yield row(out)
        if key is not None:
            yield row([(key, np.concatenate(ids), np.concatenate(chars).tobytes())])

    return rows.mapInArrow(gathered, "conv_id long, ids array<long>, chars binary")


def branched(sequences: DataFrame, every: int = 100, longest: int = 5) -> DataFrame:
    """Sequences that begin like another: conversation c takes the first h turns of c - c % every, and its own after its first h.

    h is the CRC-32 of c's decimal digits modulo longest + 1. A shorter one gives all its turns, an absent one none.
    """
    own = written(sequences, "own-turns")
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, longest).alias("head"), F.substring("chars", 1, 8 * longest).alias("head_chars"))

    def spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1024):
            ids, chars = [], []
            for conv, a, b, head, head_chars in zip(*(batch.column(i).to_pylist() for i in range(5))):
                h = crc32(b"%d" % conv) % (longest + 1)
                ids.append((head or [])[:h] + a[h:])
                chars.append((head_chars or b"")[: 8 * h] + b[8 * h :])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(chars, pa.binary())], names=["conv_id", "ids", "chars"])

    joined = own.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    return joined.select("conv_id", "ids", "chars", "head", "head_chars").mapInArrow(spliced, "conv_id long, ids array<long>, chars binary")


def conversation_trie(conversations: DataFrame, *, branch: bool = False, **options) -> DataFrame:
    """The nodes of the prefix trie of conversations, whose turns are pairs of role and text.

    For each distinct sequence of first turns, from the empty one (the root): conv_id, its smallest member; depth, its number of
    turns; parent_conv_id, the parent's conv_id (root: null); n_convs, the members, which are the conversations that
    begin with it; n_children; n_leaves, the childless nodes of its subtree; saved_tokens, over its subtree, the sum of
    each node's members but one times the code points of its last text; ends_sha256, the hash of the ids of the members that
    end there, ascending, decimal and joined by commas. With branch, conversations are first given common beginnings by
    `branched`.

    Null roles and texts are empty; turns come in order, null first, ties by role, then text, and equal rows are turns of
    their own; rows with a null conv_id are left out, as they belong to no conversation; a conversation may be left
    without turns by branch, and then ends at the root; an empty table gives no rows; other columns aren't read.
    """
    sequences = turn_sequences(conversations)
    return prefix_nodes(branched(sequences) if branch else sequences, **options)
