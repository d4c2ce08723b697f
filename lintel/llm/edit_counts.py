"""Edit-aware token counts: a segment tree over the pre-tokens of each document, updated where edits fall.

A byte-pair encoder cuts a text into pre-tokens by a pattern and encodes each on its own, so the tokens of a text are
the sum over its pre-tokens, which are the leaves of the tree. Where a pre-token ends depends on its own text and a few
characters behind it, and what follows depends on nothing before. So after an edit the pattern runs from the first
pre-token that the edit can reach to the first old boundary behind it that it meets again; pre-tokens between are encoded
again, and the sums above their leaves are updated.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from functools import cached_property, lru_cache
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer
from .arrow import map_batches
from .shared import beside

#: Characters behind a pre-token that decide where it ends: a contraction looks two ahead, a run of blanks two.
AHEAD = 3
#: Pre-tokens whose counts a task remembers.
REMEMBERED = 1 << 19


class Edit(NamedTuple):
    """Characters start to end of the text become `put`."""

    start: int
    end: int
    put: str


@lru_cache(maxsize=2)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


class Counter(dict[str, int]):
    """The number of tokens of each pre-token that was asked for, remembered; only a new one runs Python."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        self.encode = encode

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[token] = len(self.encode(token))
        return n


class TokenTree:
    """Starts of a text's leaves, which are pre-tokens, and a heap of counts: node i sums nodes 2i and 2i + 1, leaves stand from `width` on.

    Starts and heap are made when they are first asked for, so a text without edits has neither. A leaf of no characters
    has no tokens: edits that take pre-tokens away leave such ones, and where edits bring more pre-tokens than they took,
    the last leaf of the region holds the rest of them.
    """

    def __init__(self, text: str, count: Callable[[str], int], leaves: tuple[Sequence[int], Sequence[int]] | None = None, pattern: str = tokenizer.PATTERN) -> None:
        """leaves gives lengths and counts of a tree that was kept; nothing is encoded then."""
        self.text, self.count, self.pattern = text, count, _pattern(pattern)
        if leaves is None:
            tokens = self.pattern.findall(text)
            leaves = list(map(len, tokens)), list(map(count, tokens))
        lengths, counts = leaves
        if sum(lengths) != len(text) or len(lengths) != len(counts):
            raise ValueError("leaves of another text")
        self._lengths, self._counts = (lengths, counts) if len(lengths) else ([0], [0])
        self.width = 1 << (len(self._lengths) - 1).bit_length()

    @cached_property
    def starts(self) -> list[int]:
        return list(accumulate(self._lengths[:-1], initial=0))

    @cached_property
    def sums(self) -> list[int]:
        heap = np.zeros(2 * self.width, np.int64)
        heap[self.width : self.width + len(self._counts)] = self._counts
        low = self.width
        while low > 1:
            heap[low // 2 : low] = heap[low : 2 * low].reshape(-1, 2).sum(axis=1)
            low //= 2
        return heap.tolist()

    @property
    def total(self) -> int:
        return self.sums[1] if "sums" in self.__dict__ else sum(self._counts)

    @property
    def leaves(self) -> tuple[list[int], list[int]]:
        """Lengths and counts of the leaves, from which the tree can be built again without encoding."""
        if "sums" in self.__dict__:
            return self._lengths, self.sums[self.width : self.width + len(self._lengths)]
        return self._lengths, self._counts

    def _put(self, i: int, n: int) -> None:
        node, change = self.width + i, n - self.sums[self.width + i]
        while change and node:
            self.sums[node] += change
            node >>= 1

    def apply(self, edits: Sequence[Edit]) -> int:
        """Make the edits, given in the present text's characters; returns the characters that were cut into pre-tokens again.

        Edits are taken by start; one that begins before the last one's end is left out, and ends beyond the text stop
        there.
        """
        taken: list[Edit] = []
        for e in sorted(edits, key=lambda e: (e.start, e.end)):
            start, end = max(0, e.start), min(len(self.text), e.end)
            if start <= end and (not taken or start >= taken[-1].end) and (start < end or e.put):
                taken.append(Edit(start, end, e.put))
        if not taken:
            return 0
        pieces, at = [], 0
        for e in taken:
            pieces += [self.text[at : e.start], e.put]
            at = e.end
        new = "".join([*pieces, self.text[at:]])
        starts, old_end = self.starts, len(self.text)
        regions: list[tuple[int, int, list[str]]] = []  # first leaf, leaf behind the last, its new pre-tokens
        shift = again = k = 0
        while k < len(taken):
            # the leaf that holds the last character before the edit that no longer matters to those ahead of it
            first = max(0, bisect_right(starts, max(0, taken[k].start - AHEAD)) - 1)
            low = upto = starts[first] + shift
            tokens: list[str] = []
            begun = False
            while True:
                # an edit that the place reached may depend on belongs to this region, as the first one does
                while k < len(taken) and (not begun or taken[k].start + shift <= upto + AHEAD):
                    shift += len(taken[k].put) - (taken[k].end - taken[k].start)
                    changed, begun, k = taken[k].end + shift, True, k + 1
                old = upto - shift
                if upto >= changed:
                    behind = bisect_left(starts, old)
                    if old == old_end or (first < behind < len(starts) and starts[behind] == old):
                        break
                match = self.pattern.match(new, upto)
                tokens.append(match[0])
                upto = match.end()
            last = len(starts) if old == old_end else behind
            regions.append((first, last, tokens))
            again += upto - low
        self._replace(new, regions)
        return again

    def _replace(self, new: str, regions: list[tuple[int, int, list[str]]]) -> None:
        lengths = list(self._lengths)
        for first, last, tokens in regions:
            slots = last - first
            own = [len(t) for t in tokens]
            counts = [self.count(t) for t in tokens]
            if len(own) > slots:
                own[slots - 1 :] = [sum(own[slots - 1 :])]
                counts[slots - 1 :] = [sum(counts[slots - 1 :])]
            pad = slots - len(own)
            lengths[first:last] = own + [0] * pad
            for i, n in enumerate(counts + [0] * pad):
                self._put(first + i, n)
        self.text, self._lengths = new, lengths
        self.starts = list(accumulate(lengths[:-1], initial=0))


def _lists(rows: list[list[int]]) -> pa.Array:
    ends = list(accumulate(map(len, rows), initial=0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, ends[-1])))


def count_edited(docs: DataFrame, edits: Callable[[str], list[Edit]] | str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, tree: tuple[str, str] | None = None) -> DataFrame:
    """carry columns of docs with n_tokens, n_edits, n_tokens_after, n_characters_after, n_again, leaf_lengths, leaf_counts and text_after.

    edits is a column of (start, end, put) arrays or a function of the text; n_again counts the characters that were cut
    again for the edits. leaf_lengths and leaf_counts are the document's tree after them: given back with text_after as
    `tree` and text, a later round of edits starts from them and encodes nothing else. Null and empty texts have 0 tokens;
    null edits none, and without a tree the text is encoded. Rows are counted one by one, so repeated rows give repeated
    results. A carried column with the name of a result, in any case, gets _in behind it.
    """
    raw = tokenizer.send(docs.sparkSession, vocabulary)
    results = ("n_tokens", "n_edits", "n_tokens_after", "n_characters_after", "n_again", "leaf_lengths", "leaf_counts", "text_after")
    none = lambda kind: F.lit(None).cast(kind)
    given = docs[edits] if isinstance(edits, str) else none("array<struct<start:int,end:int,put:string>>")
    kept = [docs[c] for c in tree] if tree else [none("array<int>")] * 2
    names = beside([*carry], results)
    inner = docs.select(*(docs[c] for c in carry), given, *kept, docs[text]).toDF(*(f"c{i}" for i in range(len(carry))), "edits", "lengths", "counts", "text")
    fields = "".join(f"`c{i}` {inner.schema.fields[i].dataType.simpleString()}, " for i in range(len(carry)))
    schema = f"{fields}n_tokens long, n_edits long, n_tokens_after long, n_characters_after long, n_again long, leaf_lengths array<int>, leaf_counts array<int>, text_after string"

    def make():
        count = Counter(tokenizer.encoder(raw.value).encode_ordinary).__getitem__

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for own, lengths, counts, body in zip(*(batch.column(i).to_pylist() for i in range(len(carry), len(carry) + 4)), strict=True):
                body = body or ""
                made = [Edit(e["start"], e["end"], e["put"] or "") for e in own or []] if isinstance(edits, str) else edits(body)
                held = TokenTree(body, count, (lengths, counts) if lengths is not None and counts is not None else None)
                before = held.total
                again = held.apply(made)
                rows.append((before, len(made), held.total, len(held.text), again, *held.leaves, held.text))
            numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            lists = [_lists([r[i] for r in rows]) for i in (5, 6)]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *numbers, *lists, pa.array([r[7] for r in rows], pa.string())], [*batch.schema.names[: len(carry)], *results])

        return each

    return map_batches(inner, schema, make).toDF(*names, *results)
