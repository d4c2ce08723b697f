"""Token-id rows by best-fit-decreasing packing.

Each task encodes its documents, cuts those longer than a row into full rows and a rest, and packs what it holds into
rows: longest piece first, each into the open row with the least room that still takes it. A segment tree over
capacities finds that row. Nothing is shuffled, and a task holds one group of tokens at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer
from .arrow import bounded

ROW_TOKENS = 2_048
#: Ends each document; also fills rows.
END, FILL = 50_256, 50_256
#: Tokens that a task packs at once.
GROUP_TOKENS = 1 << 20

SCHEMA = "pack_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"


class Piece(NamedTuple):
    doc: int | None
    offset: int
    ids: np.ndarray


class Capacities:
    """A segment tree over capacities 0 to most that counts rows with that much room."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int = 1) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def least(self, need: int) -> int | None:
        """The least capacity of need or more that some row has."""
        node = self.leaves + need
        if not self.count[node]:
            # up to the first right neighbour with rows, then down its left side
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def pack(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Rows of indices of lengths (1 to capacity each) by best fit, longest first; equal lengths in order."""
    tree, room, rows = Capacities(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.least(lengths[i])
        if found is None:
            row, found = len(rows), capacity
            rows.append([i])
        else:
            row = room[found].pop()
            tree.add(found, -1)
            rows[row].append(i)
        left = found - lengths[i]
        if left:
            room.setdefault(left, []).append(row)
            tree.add(left)
    return rows


def split(doc: int | None, ids: np.ndarray, capacity: int) -> list[Piece]:
    """The tokens of a document in pieces of capacity, and a rest, in order."""
    return [Piece(doc, at, ids[at : at + capacity]) for at in range(0, len(ids), capacity)]


def _batch(pieces: list[Piece], capacity: int, fill: int, kind: type, first: int) -> pa.RecordBatch:
    rows = pack([len(p.ids) for p in pieces], capacity)
    matrix = np.full((len(rows), capacity), fill, kind)
    ends, docs, offsets = [], [], []
    for at, row in enumerate(rows):
        own = [pieces[i] for i in row]
        joined = np.concatenate([p.ids for p in own])
        matrix[at, : len(joined)] = joined
        ends.append([0, *np.cumsum([len(p.ids) for p in own]).tolist()])
        docs.append([p.doc for p in own])
        offsets.append([p.offset for p in own])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(range(first, first + len(rows)), pa.int64()),
            pa.array([e[-1] for e in ends], pa.int32()),
            pa.array([r.tobytes() for r in matrix], pa.binary()),
            pa.array(ends, pa.list_(pa.int32())),
            pa.array([e[:-1] for e in ends], pa.list_(pa.int32())),
            pa.array(docs, pa.list_(pa.int64())),
            pa.array(offsets, pa.list_(pa.int64())),
        ],
        ["pack_id", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"],
    )


def pack_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = ROW_TOKENS, vocabulary: str | None = None, end: int | None = END, fill: int = FILL, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packed rows: pack_id, n_tokens, input_ids, cu_seqlens, position_resets, doc_ids, doc_offsets.

    input_ids holds capacity ids of two little-endian bytes, or four where an id needs them, filled up with fill.
    Segments follow each other in a row; cu_seqlens is 0 and the end of each, position_resets where each starts and
    positions begin at 0 again. A segment is all of a document's tokens (its end token last) or, of a document longer
    than a row, the part from its doc_offset on, so the parts by offset give back every token. Null and empty texts
    have no segment; repeated rows and null keys are packed like others; an empty table gives no rows. pack_id is
    unique, and the same when a lost task runs again.
    """
    if capacity < 1:
        raise ValueError("rows need room")
    raw = tokenizer.send(docs.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer.encoder(raw.value).encode_ordinary
        top = max(end or 0, fill, raw.value.count(b"\n") + 1)
        kind = np.uint16 if top <= 0xFFFF else np.uint32
        tail, held, size, first = [] if end is None else [end], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not body:
                    continue
                ids = np.array(encode(body) + tail, kind)
                held += split(doc, ids, capacity)
                size += len(ids)
                if size >= group_tokens:
                    out = _batch(held, capacity, fill, kind, first)
                    first, held, size = first + out.num_rows, [], 0
                    yield from (out.slice(i, 512) for i in range(0, out.num_rows, 512))
        if held:
            out = _batch(held, capacity, fill, kind, first)
            yield from (out.slice(i, 512) for i in range(0, out.num_rows, 512))

    return bounded(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))).mapInArrow(run, SCHEMA)


def positions(cu_seqlens: Sequence[int], capacity: int) -> np.ndarray:
    """Position ids of a row: from 0 in each segment, and in the filling."""
    edges = np.array([*cu_seqlens, capacity])
    starts = np.repeat(edges[:-1], np.diff(edges))
    return np.arange(capacity) - starts


def matrix(rows: Sequence, capacity: int = ROW_TOKENS) -> np.ndarray:
    """The id matrix of collected packed rows."""
    kind = np.uint16 if all(len(r["input_ids"]) == 2 * capacity for r in rows) else np.uint32
    return np.stack([np.frombuffer(r["input_ids"], kind) for r in rows]) if rows else np.empty((0, capacity), np.uint16)
