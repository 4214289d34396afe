"""Byte-level BPE ids, and edit-aware token counts.

The ids are those of ``byte_bpe_50k.json`` under the ``tokenizers`` library with its defaults, so the added token is
found inside texts; the encoder is ``tiktoken`` over the same vocabulary's rank file, as it is several times faster (tests
compare the two).
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from wearstream.llm.common import small_batches

#: Fixed value: the vocabulary's split pattern, in the form without backtracking.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: Fixed value: the vocabulary's added tokens, which the rank file lacks. They hold no white space.
ADDED = {"<|endoftext|>": 50256}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of texts; an added token's string is that token. Each task makes one."""

    def __init__(self, ranks_path: str | None = None):
        import tiktoken

        with open(ranks_path or default_ranks(), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        plain = tiktoken.Encoding("byte_bpe_50k", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=ADDED)
        self.encode = partial(plain.encode, allowed_special=set(ADDED), disallowed_special=())

    def ids_bytes(self, text: str, end_id: int) -> bytes:
        """The ids and then end_id, as little-endian unsigned 32-bit integers."""
        ids = array("I", self.encode(text))
        ids.append(end_id)
        return ids.tobytes()

    def count(self, text: str) -> int:
        return len(self.encode(text))


#: A space before a letter always begins a pre-token, and what stands on either side of it is encoded independently. An
#: added token has no space, so no cut divides one, nor can an edit make one across a cut that stays.
CUT = re.compile(" (?=[A-Za-z])")


class CountTree:
    """Token count of one text under edits: a segment tree over stretches of the text that encode independently.

    The leaves begin at a space before a letter. An edit re-encodes the leaves that it touches, with the one before
    where it begins at a leaf's first two characters, since those made the edge; then only the sums above them change. An
    edit costs the leaves it touches and the tree's height, not the text's length; the leaves' texts are joined at the end.
    """

    def __init__(self, text: str, count, leaf_chars: int = 256):
        self.count, self.recoded = count, 0
        cuts, at = [0], CUT.search(text, leaf_chars)
        while at:
            cuts.append(at.start())
            at = CUT.search(text, at.start() + leaf_chars)
        self.leaves, self.size = len(cuts), 1
        while self.size < self.leaves:
            self.size *= 2
        self.tokens, self.chars = [0] * (2 * self.size), [0] * (2 * self.size)
        self.parts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
        for i, part in enumerate(self.parts):
            self.tokens[self.size + i], self.chars[self.size + i] = count(part), len(part)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.parts)

    @property
    def length(self) -> int:
        return self.chars[1]

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at, or else the last with text, and where it starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _put(self, leaf: int, part: str) -> None:
        i = self.size + leaf
        self.parts[leaf], self.tokens[i], self.chars[i] = part, self.count(part) if part else 0, len(part)
        while i > 1:
            i //= 2
            self._sum(i)

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts new in place of the characters from start to end."""
        first, at = self._leaf_at(start)
        while first > 0 and (start < at + 2 or not self.chars[self.size + first]):
            first -= 1
            at -= self.chars[self.size + first]
        last, stop = first + 1, at + self.chars[self.size + first]
        while last < self.leaves and stop < end:
            stop += self.chars[self.size + last]
            last += 1
        touched = "".join(self.parts[first:last])
        touched = touched[: start - at] + new + touched[end - at :]
        self.recoded += len(touched)
        self._put(first, touched)
        for leaf in range(first + 1, last):
            if self.parts[leaf]:
                self._put(leaf, "")


#: What a redaction takes out: mail addresses, and runs of five digits or more with the marks that join them. Runs begin
#: at their first character and are not given back, so a long one is read once.
PRIVATE = r"(?<![\w.+-])[\w.+-]++@[\w-]++\.[\w.]++|\+?\d(?:[.:/()-]?\d){4,}+"


def count_tokens(docs: DataFrame, *, private: str = PRIVATE, mark: str = "[redacted]", ranks_path: str | None = None) -> DataFrame:
    """Token counts of every document before and after its private spans are edited out, by a tree of counts.

    The edits of a document are made one after the other; each re-encodes only what it touches. Returns doc_id,
    n_tokens, n_edits, edited_tokens, edited_chars and recoded_chars (characters that the edits encoded again). A null
    text counts as empty (0 tokens, no edits); repeated rows and ids give a row each; a null doc_id is kept; an empty
    table gives no rows; other columns aren't read. Nothing is shuffled, and memory holds a few hundred texts.
    """
    names = ["n_tokens", "n_edits", "edited_tokens", "edited_chars", "recoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, pattern = Encoder(ranks_path).count, re.compile(private)
        for batch in small_batches(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                tree = CountTree(text or "", count)
                before, shift, edits = tree.total, 0, 0
                for m in pattern.finditer(text or ""):
                    tree.replace(m.start() + shift, m.end() + shift, mark)
                    shift += len(mark) - (m.end() - m.start())
                    edits += 1
                rows.append((before, edits, tree.total, tree.length, tree.recoded))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *names])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *names]))
