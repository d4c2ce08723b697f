"""Benchmark decontamination: windows of normalised benchmark words in a broadcast hash set, looked up in every text.

Windows are hashed; a bitmap and a sorted table sort out nearly all places, and what is left is compared byte by byte
with the benchmark's own words. The index of a slice of the benchmark is its normalised text and, for each window, a
hash and a place: under four times the text. One slice at most is broadcast at a time. A larger benchmark is looked up
slice by slice, and each pass writes what it found to the shared folder before the next one begins.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import NON_WORD_BYTES, WordHasher, map_batches, texts, windows
from .shared import if_small, settle

WINDOW = 13
#: Bytes of benchmark text in one broadcast index; a larger benchmark falls into slices of about half of it.
SLICE_BYTES = 16 << 20
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


class Windows(NamedTuple):
    """The distinct windows of one length in each item, by hash. `new` marks the first of each run of equal windows."""

    bitmap: np.ndarray
    hashes: np.ndarray
    places: np.ndarray
    new: np.ndarray


class Index(NamedTuple):
    """The items' words, each followed by a blank; the first byte of each item; item ids; windows by length."""

    words: bytes
    edges: np.ndarray
    names: list[str]
    windows: dict[int, Windows]

    @property
    def nbytes(self) -> int:
        return len(self.words) + self.edges.nbytes + sum(map(len, self.names)) + sum(a.nbytes for w in self.windows.values() for a in w)


def _table(hashes: np.ndarray, places: np.ndarray, ends: np.ndarray, items: np.ndarray, words: bytes) -> Windows:
    order = np.argsort(hashes, kind="stable")
    hashes, places, ends, items = (a[order] for a in (hashes, places, ends, items))
    keep, new = np.ones(len(hashes), bool), np.ones(len(hashes), bool)
    again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    # runs of equal hashes: by words, then by item, each item once
    for run in np.split(again, np.flatnonzero(np.diff(again) > 1) + 1) if len(again) else []:
        at = np.arange(run[0] - 1, run[-1] + 1)
        own = sorted((words[places[i] : ends[i]], int(items[i]), int(places[i])) for i in at.tolist())
        for k, (i, (window, item, place)) in enumerate(zip(at.tolist(), own, strict=True)):
            places[i] = place
            new[i] = k == 0 or window != own[k - 1][0]
            keep[i] = new[i] or item != own[k - 1][1]
    hashes, places, new = hashes[keep], places[keep], new[keep]
    bits = max(8, int(2 * len(hashes)).bit_length())
    bitmap = np.zeros(1 << bits, bool)
    bitmap[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
    return Windows(bitmap, hashes, places, new)


def index_of(items: list[tuple[str, bytes]], length: int = WINDOW) -> Index:
    """The index of some items (id, text); an item of fewer words than a window has one window of all its words."""
    hasher = WordHasher(NON_WORD_BYTES)
    bodies, edges, size = [], [], 0
    found: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for name, body in items:
        edges.append(size)
        words = b"".join(w + b" " for w in hasher.words(body))
        hashes, starts, ends = hasher(words)
        n = min(length, len(hashes))
        if n:
            seen = windows(hashes, n)
            found.setdefault(n, []).append((seen, size + starts[: len(seen)], size + ends[n - 1 :], np.full(len(seen), len(edges) - 1)))
        bodies.append(words)
        size += len(words)
    whole = b"".join(bodies)
    kind = np.uint32 if size < 1 << 32 else np.int64
    joined = {n: [np.concatenate(x) for x in zip(*parts, strict=True)] for n, parts in found.items()}
    return Index(whole, np.array(edges, kind), [name for name, _ in items], {n: _table(h, p.astype(kind), e, i, whole) for n, (h, p, e, i) in joined.items()})


def _lookup(index: Index, hasher: WordHasher, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit windows as (first word, end), and items."""
    hashes, starts, ends = hasher(text)
    spans, items = [], set()
    for n, known in index.windows.items():
        told: set[int] = set()
        seen = windows(hashes, n)
        maybe = np.flatnonzero(known.bitmap[(seen >> np.uint64(64 - int(len(known.bitmap) - 1).bit_length())).astype(np.int64)])
        low, high = (np.searchsorted(known.hashes, seen[maybe], side) for side in ("left", "right"))
        for i, at, end in zip(*(x[low < high].tolist() for x in (maybe, low, high)), strict=True):
            words = b" ".join(hasher.words(text[starts[i] : ends[i + n - 1]])) + b" "
            while at < end:
                after = at + 1
                while after < end and not known.new[after]:
                    after += 1
                if index.words.startswith(words, int(known.places[at])):
                    spans.append((i, i + n))
                    if at not in told:
                        told.add(at)
                        items.update(index.names[k] for k in (np.searchsorted(index.edges, known.places[at:after], "right") - 1).tolist())
                    break
                at = after
    return len(hashes), spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _flat(spans: list[tuple[int, int]]) -> list[int]:
    return [x for span in _merged(spans) for x in span]


def _cut(hasher: WordHasher, text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    _, starts, ends = hasher(text)
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, text[at:]])


_FOUND = [T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
_COUNTED = [*_FOUND, T.StructField("n_words", T.LongType())]
_ARROW = pa.list_(pa.int64()), pa.list_(pa.string())


def _looked_up(rows: DataFrame, at: int, items: DataFrame, length: int, hits_only: bool):
    """rows with spans and items of one slice (i, t) and n_words, of the text in column number at; and the broadcast index."""
    index = index_of([(r["i"], r["t"].encode()) for r in items.orderBy("i", "t").collect()], length)
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def make():
        known, hasher = shared.value, WordHasher(NON_WORD_BYTES)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [_lookup(known, hasher, body or b"") for body in texts(batch.column(at))]
            told = [pa.array([_flat(s) for _, s, _ in found], _ARROW[0]), pa.array([sorted(x) for *_, x in found], _ARROW[1]), pa.array([n for n, *_ in found], pa.int64())]
            out = pa.RecordBatch.from_arrays([*batch.columns, *told], [*batch.schema.names, "spans", "items", "n_words"])
            return out.filter(pa.array([bool(s) for _, s, _ in found], pa.bool_())).drop_columns([batch.schema.names[at]]) if hits_only else out

        return each

    kept = [f for i, f in enumerate(rows.schema.fields) if not (hits_only and i == at)]
    return map_batches(rows, T.StructType([*kept, *_COUNTED]), make), shared


def _in_slices(numbered: DataFrame, at: int, items: DataFrame, n: int, length: int) -> DataFrame:
    """numbered with spans and items, one slice after the other. Texts are named by their SHA-256, so copies are one."""
    body = numbered.columns[at]
    named = numbered.select(F.sha2(body, 256).alias("sha"), body).where(F.col(body).isNotNull())
    parts = None
    for k in range(n):
        found, shared = _looked_up(named, 1, items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k), length, True)
        part = settle(found.drop("n_words").distinct(), "benchmark-hits")
        shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    gathered = parts.groupBy("sha").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = [_flat(list(zip(s[::2], s[1::2], strict=True))) for s in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW[0]), pa.array([sorted(x) for x in batch.column(2).to_pylist()], _ARROW[1])], batch.schema.names)

        return each

    merged = settle(map_batches(gathered, T.StructType([T.StructField("sha", T.StringType()), *_FOUND]), make), "benchmark-found")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    joined = numbered.withColumn("sha", F.sha2(body, 256)).join(if_small(merged), "sha", "left")
    return joined.select(*numbered.columns, none("spans", "array<long>"), none("items", "array<string>"), F.regexp_count(F.coalesce(F.col(body), F.lit("")), F.lit(_WORD)).cast("long").alias("n_words"))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", length: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs, its columns named c0, c1, ..., with spans (merged word ranges found in the benchmark, flat), items, n_words and n_hit.

    A window is so many consecutive words of an item, or all of a shorter item. Null and empty texts have no words and
    no hits, null items and null ids no windows; repeated benchmark rows count by id. Repeated rows and any further
    columns, whatever their names, stay. A benchmark of up to slice_bytes of text is one broadcast index, and nothing is
    shuffled. A larger one is dealt by hash to slices of about half of that; each is a pass of its own over the texts,
    with its index alone in memory, which writes its hits, and the hits of a text then join it by its SHA-256. One item
    is never cut, so an index is as large as its largest item at least.
    """
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = docs.columns.index(text)
    items = benchmark.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    volume = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    found = _looked_up(numbered, at, items, length, False)[0] if volume <= slice_bytes else _in_slices(numbered, at, items, -(-2 * volume // slice_bytes), length)
    total = lambda odd: F.aggregate(F.filter("spans", lambda _, i: i % 2 == odd), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.withColumn("n_hit", total(1) - total(0))


def contaminated(n_hit, n_words, parts: int = 20):
    """At least one hit, and hits in a 20th of the words or more."""
    return (n_hit > 0) & (parts * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", spans: bool = False, length: int = WINDOW) -> DataFrame:
    """docs without contaminated documents; with spans, the hit words of the others are cut from their texts as well.

    Columns, repeated rows and clean texts stay as they are. See scan() for odd rows.
    """
    names = docs.columns
    kept = scan(docs, benchmark, text, item, length).where(~contaminated(F.col("n_hit"), F.col("n_words")))
    if spans:
        at = docs.columns.index(text)

        def make():
            hasher = WordHasher(NON_WORD_BYTES)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                where = batch.schema.get_field_index("spans")
                cut = [b if not s else _cut(hasher, b, s) for b, s in zip(texts(batch.column(at)), batch.column(where).to_pylist(), strict=True)]
                columns = batch.columns
                columns[at] = pa.array([None if x is None else x.decode() for x in cut], pa.string())
                return pa.RecordBatch.from_arrays(columns, batch.schema.names)

            return each

        kept = map_batches(kept, kept.schema, make)
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
