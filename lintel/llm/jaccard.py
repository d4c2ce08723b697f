"""Exact n-gram Jaccard join as a blocked product of the document by n-gram incidence with its transpose.

A document is the set of hashes of its distinct word 5-grams; documents with equal sets are one node from the start.
The n-grams are dealt to blocks by their hash. In each block the overlaps of documents are counted over the rarest
n-grams only: with all n-grams in one order (rare ones, then common ones, then hot ones, each by hash), two documents of
sizes m and n that link share one of their first m - ceil(3m/4) + 1 and n - ceil(3n/4) + 1. A pair whose count, summed
over the blocks, cannot reach ceil(3(m + n) / 7) with what the prefixes leave open is dropped. What is left falls into
candidate classes, whose documents meet once in document blocks for the full product, and links there are exact. Blocks
hold documents of one size band, and only bands that links reach across meet.

Where prefixes reach common or hot n-grams, documents of such an n-gram are strung to one of them, which keeps
candidates whole, instead of being paired: first within each task, which passes on one document for each of its strings,
and then in the n-gram's block, so no block holds a posting for each document of a hot n-gram. Strings may join what one
shared passage has in common and no more. So the documents of large classes are counted a second time, with longer
prefixes whose common n-grams are paired, and only hot ones strung.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import BLANK_BYTES, WordHasher, bounded, mixed, texts, windows
from .components import components, forest
from .shared import drop, if_small, settle

WORDS = 5
PERCENT = 75
#: An n-gram in more documents than the first is common, in more than the second hot. So many of both are known to all tasks at most, the most frequent first.
FREQUENT, HOT, MOST_FREQUENT = 16, 128, 1_000_000
#: Classes of more documents are counted again; then a document whose prefix holds common n-grams enters with this part of all.
LARGE, LONG = 256, 0.8
#: Pairs that a block holds before it adds them up.
PAIRS = 1 << 22
#: Bytes of text for each n-gram block, and the least number of blocks.
BLOCK_BYTES, LEAST_BLOCKS = 4 << 20, 16
#: Bytes of text for each n-gram block of the second count.
AGAIN_BYTES = 1 << 20
#: Entries that a task gathers before it deals them out.
FLUSH = 1 << 18
#: Documents and columns of the full product's blocks; sizes of one band are within a third of each other, and a little more.
DOC_BLOCK, COLUMN_BLOCK = 64, 8_192
BAND = 1.001 * math.log(100 / PERCENT)
_ALWAYS = 1 << 30


def shingles(hasher: WordHasher, text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct 5-grams; one for a shorter text, none for a text without words."""
    hashes = hasher(text or b"")[0]
    return np.unique(windows(hashes, min(WORDS, len(hashes)))) if len(hashes) else hashes


def signature(own: np.ndarray) -> int:
    """A 64-bit signed hash of a set, which names its node."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def _prefix(n: int) -> int:
    return n + (-PERCENT * n // 100) + 1


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(blocks)) >> np.uint64(32)


def _name(h: np.ndarray, blocks: int) -> np.ndarray:
    """Block and upper hash half of an n-gram in one number, as far as blocks tell n-grams apart."""
    return (_block(h, blocks) << np.uint64(32)) | (h >> np.uint64(32))


def _dealt(h: np.ndarray, blocks: int, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(block, its entries): the count, the upper hash halves, then the other columns."""
    block = _block(h, blocks).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, columns = block[order], [(h >> np.uint64(32)).astype(np.uint32)[order], *(c[order] for c in columns)]
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(block[a]), b"".join([np.uint32(b - a).tobytes(), *(c[a:b].tobytes() for c in columns)])


def _gathered(blobs: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    """The columns of several entries of _dealt, joined."""
    parts: list[list[np.ndarray]] = [[np.empty(0, kind)] for kind in [np.uint32, *kinds]]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.uint32, 1)[0]), 4
        for part, kind in zip(parts, [np.uint32, *kinds], strict=True):
            part.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) for p in parts]


def _catalogue(rows: DataFrame, blocks: int) -> DataFrame:
    """(key, h, sig, n) of each row, and (block, entries) with the n-grams of the sets that a task meets, and their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, held, size = WordHasher(BLANK_BYTES), set(), [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            dealt = list(_dealt(values, blocks, [counts.astype(np.uint32)]))
            none = pa.nulls(len(dealt), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array([d[0] for d in dealt], pa.int64()), pa.array([d[1] for d in dealt], pa.binary())], ["key", "h", "sig", "n", "block", "entries"])

        for batch in batches:
            sigs, sizes = [], []
            for body in texts(batch.column(2)):
                own = shingles(hasher, body)
                sizes.append(len(own))
                sigs.append(signature(own) if len(own) else None)
                if len(own) and sigs[-1] not in seen:
                    seen.add(sigs[-1])
                    held.append(own)
                    size += len(own)
            none = pa.nulls(len(sigs))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()), none.cast(pa.int64()), none.cast(pa.binary())], ["key", "h", "sig", "n", "block", "entries"])
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return bounded(rows).mapInArrow(run, "key long, h long, sig long, n long, block long, entries binary")


def _frequent(catalogue: DataFrame, above: int, hot: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names of the n-grams that more than so many sets hold, the most frequent where there are too many, and whether they are hot."""

    def count(table: pa.Table) -> pa.Table:
        halves, counts = _gathered(table.column("entries").to_pylist(), [np.uint32])
        values, place = np.unique(halves, return_inverse=True)
        totals = np.bincount(place, counts, len(values)).astype(np.int64)
        often = totals > above
        names = (np.uint64(table.column("block")[0].as_py()) << np.uint64(32)) | values[often].astype(np.uint64)
        return pa.table({"name": names.view(np.int64), "n": totals[often]})

    found = settle(catalogue.where(F.col("block").isNotNull()).select("block", "entries").groupBy("block").applyInArrow(count, "name long, n long"), "jaccard-frequent")
    rows = found.orderBy(F.col("n").desc(), "name").limit(most).select("name", (F.col("n") > hot).alias("hot")).toArrow()
    drop(found)
    if not rows.num_rows:
        return np.empty(0, np.uint64), np.empty(0, bool)
    names, is_hot = (c.combine_chunks().to_numpy(zero_copy_only=False) for c in rows.columns)
    order = np.argsort(names.view(np.uint64))
    return names.view(np.uint64)[order], is_hot[order].astype(bool)


def _place(names: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where names stand among the known ones, and whether they do."""
    if not len(known):
        return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    return at, known[at] == names


class Strings(NamedTuple):
    """Documents that hold an n-gram, parted where sizes are further apart than links allow."""

    heads: np.ndarray
    tops: np.ndarray
    edges: np.ndarray


def _strung(names: np.ndarray, sizes: np.ndarray, tops: np.ndarray) -> Strings:
    """Strings of rows sorted by name and size, each of sizes up to its top: rows of their heads, their tops, and (head, other) rows."""
    n = len(names)
    if not n:
        return Strings(np.empty(0, np.int64), tops, np.empty((2, 0), np.int64))
    group = np.cumsum(np.concatenate([[0], names[1:] != names[:-1]]))
    # the largest size so far within a name, as a running maximum that each name lifts
    lift = group * (int(tops.max()) + 1)
    reach = np.maximum.accumulate(tops + lift) - lift
    first = np.concatenate([[True], (group[1:] != group[:-1]) | (PERCENT * sizes[1:] > 100 * reach[:-1])])
    heads = np.flatnonzero(first)
    last = np.concatenate([heads[1:], [n]]) - 1
    head = np.repeat(heads, np.diff(np.concatenate([heads, [n]])))
    other = np.arange(n)
    return Strings(heads, reach[last], np.stack([head, other])[:, head != other])


def _postings(rows: DataFrame, blocks: int, frequent, again: int = 0) -> DataFrame:
    """The postings of rows, over so many blocks the first time, and over `again` blocks the second.

    Rows of three kinds: (block, paired), for each paired n-gram in a prefix its upper half, node, size and what lies beyond the paired part; (block, strung), for each string of a hot n-gram its upper half, head, size and largest size; (block, edges), pairs (a, b) of strings, by a.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (known, hot), seen = WordHasher(BLANK_BYTES), frequent.value, set()
        held: list[tuple[np.ndarray, int, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = [len(x[0]) for x in held]
            column = lambda i, kind: np.repeat(np.array([x[i] for x in held], kind), lengths)
            h, sigs, sizes, cool = np.concatenate([x[0] for x in held]), column(1, np.int64), column(2, np.int64), column(3, np.int64)
            pair = np.concatenate([np.arange(len(x[0])) < x[3] for x in held])
            paired = list(_dealt(h[pair], again or blocks, [sigs[pair], sizes[pair].astype(np.uint32), (sizes - cool)[pair].astype(np.uint32)])) if pair.any() else []
            at = np.flatnonzero(~pair)
            at = at[np.lexsort((sigs[at], sizes[at], h[at]))]
            strings = _strung(h[at], sizes[at], sizes[at])
            head = at[strings.heads]
            strung = list(_dealt(h[head], again or blocks, [sigs[head], sizes[head].astype(np.uint32), strings.tops.astype(np.uint32)])) if len(head) else []
            a, b = forest(*sigs[at][strings.edges])
            edges = list(_dealt(mixed(a.view(np.uint64)), again or blocks, [a, b])) if len(a) else []
            kinds = [paired, strung, edges]
            columns = [pa.array([d[0] for kind in kinds for d in kind], pa.int64())]
            columns += [pa.array([d[1] if own is kind else None for kind in kinds for d in kind], pa.binary()) for own in kinds]
            return pa.RecordBatch.from_arrays(columns, ["block", "paired", "strung", "edges"])

        for batch in batches:
            for body in texts(batch.column(0)):
                own = shingles(hasher, body)
                sig = signature(own) if len(own) else None
                if sig is None or sig in seen:
                    continue
                seen.add(sig)
                n = len(own)
                at, often = _place(_name(own, blocks), known)
                warm = often & hot[at] if len(hot) else often
                ordered = np.concatenate([own[~often], own[often & ~warm], own[warm]])
                cool, length = n - int((warm if again else often).sum()), _prefix(n)
                if again and n - int(often.sum()) < length <= cool:
                    length = max(length, min(cool, math.ceil(LONG * n)))
                first = ordered[:length]
                cool = min(length, cool)
                held.append((first, sig, n, cool))
                size += len(first)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return bounded(rows).mapInArrow(run, "block long, paired binary, strung binary, edges binary")


def _needed(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The least overlap of sets of these sizes that link."""
    return -(-PERCENT * (m + n) // (100 + PERCENT))


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The codes once each, with the sums of their counts."""
    values, place = np.unique(np.concatenate(codes), return_inverse=True)
    return [values], [np.bincount(place, np.concatenate(counts), len(values)).astype(np.int64)]


def _candidates(postings: DataFrame, most: int) -> DataFrame:
    """(a, b): pairs whose count over all blocks may reach what they need, and pairs of strings. An n-gram of more documents than `most` is strung."""

    def product(table: pa.Table) -> pa.Table:
        halves, sigs, sizes, open_ = _gathered([x for x in table.column("paired").to_pylist() if x], [np.int64, np.uint32, np.uint32])
        nodes, first, node = np.unique(sigs, return_index=True, return_inverse=True)
        size, left_open, n = sizes[first].astype(np.int64), open_[first].astype(np.int64), len(nodes)
        # a node that several tasks met stands once
        order = np.lexsort((node, halves))
        order = order[np.concatenate([[True], (halves[order][1:] != halves[order][:-1]) | (node[order][1:] != node[order][:-1])])] if n else order
        halves, node = halves[order], node[order]
        edges = np.flatnonzero(np.concatenate([[True], halves[1:] != halves[:-1], [True]])) if n else np.zeros(1, np.int64)
        often = np.diff(edges)
        codes, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        # all n-grams of m documents at once: pairs of their i-th and j-th
        for m in np.unique(often[(often > 1) & (often <= most)]).tolist():
            starts = edges[:-1][often == m]
            i, j = np.triu_indices(m, 1)
            for s in np.array_split(starts, 1 + len(starts) * len(i) // PAIRS):
                one, two = node[(s[:, None] + i).ravel()], node[(s[:, None] + j).ravel()]
                near = (100 * size[one] >= PERCENT * size[two]) & (100 * size[two] >= PERCENT * size[one])
                codes.append(one[near] * n + two[near])
                counts.append(np.ones(len(codes[-1]), np.int64))
                if sum(map(len, codes[1:])) > PAIRS:
                    codes, counts = _added(codes, counts)
        (code,), (got,) = _added(codes, counts)
        one, two = np.divmod(code, max(n, 1))
        need = _needed(size[one], size[two]) - np.maximum(left_open[one], left_open[two])
        # hot ones that are not known as such are strung here
        many = np.repeat(often > most, often)
        names, heads, low, top = _gathered([x for x in table.column("strung").to_pylist() if x], [np.int64, np.uint32, np.uint32])
        names, heads, low, top = (np.concatenate(x) for x in ((names, halves[many]), (heads, nodes[node[many]]), (low.astype(np.int64), size[node[many]]), (top.astype(np.int64), size[node[many]])))
        order = np.lexsort((heads, low, names))
        given = _gathered([x for x in table.column("edges").to_pylist() if x], [np.int64, np.int64])[1:]
        a, b = forest(*np.concatenate([heads[order][_strung(names[order], low[order], top[order]).edges], given], axis=1))
        a, b = np.concatenate([nodes[one], np.minimum(a, b)]), np.concatenate([nodes[two], np.maximum(a, b)])
        strung = len(a) - len(one)
        return pa.table({"a": a, "b": b, "need": np.concatenate([need, np.ones(strung, np.int64)]), "got": np.concatenate([got, np.full(strung, _ALWAYS)])})

    # a 20th less than needed passes, for n-grams of one set that hash halves and block cannot tell apart
    found = postings.groupBy("block").applyInArrow(product, "a long, b long, need long, got long")
    return found.groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("got").alias("got")).where("20 * got >= 19 * need").select("a", "b")


def _verified(sets: DataFrame) -> DataFrame:
    """(sig, root, links) of the documents of each pair of blocks i and j, from (class, i, j, part, sig, copies, own); root is the least node that a document links with there, directly or not, links the documents that it links with."""

    def product(table: pa.Table) -> pa.Table:
        columns = {name: table.column(name).to_pylist() for name in ("sig", "part", "copies", "own")}
        first: dict[int, int] = {}
        for at, sig in enumerate(columns["sig"]):
            first.setdefault(sig, at)
        at = [first[s] for s in sorted(first)]
        sigs, part, copies = (np.array([columns[c][x] for x in at], np.int64) for c in ("sig", "part", "copies"))
        own = [np.frombuffer(columns["own"][x], np.uint64) for x in at]
        sizes = np.array([len(x) for x in own], np.int64)
        _, column, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(own)), sizes)
        shared = often[column] > 1
        place = np.cumsum(often > 1) - 1
        row, column, width = row[shared], place[column[shared]], int((often > 1).sum())
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        overlap = np.zeros((len(own), len(own)), np.float64)
        for low in range(0, width, COLUMN_BLOCK):
            a, b = np.searchsorted(column, [low, low + COLUMN_BLOCK])
            block = np.zeros((len(own), min(COLUMN_BLOCK, width - low)), np.float32)
            block[row[a:b], column[a:b] - low] = 1
            overlap += block @ block.T
        union = sizes[:, None] + sizes[None, :] - overlap
        link = 100 * overlap >= PERCENT * union
        np.fill_diagonal(link, False)
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            link &= part[:, None] != part[None, :]
        label = np.arange(len(own))
        while True:
            after = np.minimum(label, np.where(link, label[None, :], len(own)).min(axis=1, initial=len(own)))
            after = np.minimum(after, after[after])
            if (after == label).all():
                break
            label = after
        return pa.table({"sig": sigs, "root": sigs[label], "links": (link @ copies).astype(np.int64)})

    return sets.groupBy("class", "i", "j").applyInArrow(product, "sig long, root long, links long")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (row, sig, class, copies, part, others) with the set of each node's text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(BLANK_BYTES)
        for batch in batches:
            own = [shingles(hasher, body) for body in texts(batch.column(0))]
            right = [len(x) > 0 and signature(x) == sig for x, sig in zip(own, batch.column(1).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x.tobytes() for x in own], pa.binary())], [*batch.schema.names[1:], "own"])
            yield out.filter(pa.array(right, pa.bool_()))

    joined = rows.join(if_small(wanted), "row").select("text", "sig", "class", "copies", "part", "others")
    return bounded(joined).mapInArrow(run, "sig long, class long, copies long, part long, others array<long>, own binary")


def _dealt_to_blocks(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(row, sig, class, copies, part, others): each node of a class with its block and all blocks that it meets.

    A class of more than a block is cut by size band, and each band into blocks by hash; a band meets its neighbours.
    """
    members = classes.select(F.col("node").alias("sig"), F.col("root").alias("class")).unionByName(classes.select(F.col("root").alias("sig"), F.col("root").alias("class")).distinct())
    own = settle(nodes.join(members, "sig").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / BAND).cast("int")), "jaccard-members")
    counted = own.groupBy("class", "band").agg(F.count("*").alias("m")).groupBy("class")
    bands = settle(counted.agg(F.sum("m").alias("size"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("m") / DOC_BLOCK).cast("int").alias("parts")))).alias("parts")), "jaccard-bands")
    joined = own.join(if_small(bands), "class")
    parts = lambda band: F.coalesce(F.try_element_at("parts", band), F.lit(0))
    block = lambda band, i: F.shiftleft(band.cast("long"), 32) + i
    blocks = lambda band: F.when(parts(band) > 0, F.transform(F.sequence(F.lit(0), parts(band) - 1), lambda i: block(band, i))).otherwise(F.array().cast("array<long>"))
    band, one = F.col("band"), F.col("size") <= DOC_BLOCK
    part = block(band, F.pmod(F.xxhash64("sig"), parts(band)))
    return joined.select("row", "sig", "class", "copies", F.when(one, F.lit(0).cast("long")).otherwise(part).alias("part"), F.when(one, F.array(F.lit(0).cast("long"))).otherwise(F.concat(blocks(band - 1), blocks(band), blocks(band + 1))).alias("others"))


def _classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, n, component, kept_h, n_links) of each row; h is a hash of its text, and component and kept_h are those of the first row of its class, by key and h."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    row = F.coalesce("key", "h").alias("row")
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, volume // BLOCK_BYTES)
    catalogue = settle(_catalogue(rows, blocks), "jaccard-catalogue")
    entries = catalogue.where(F.col("block").isNull()).select("key", "h", "sig", "n")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(catalogue, FREQUENT, HOT, MOST_FREQUENT))
    nodes = settle(entries.where("sig is not null").select("sig", "key", "h", "n", row).groupBy("sig").agg(F.min("row").alias("row"), F.min(F.struct(F.col("key").isNull().alias("blank"), "key", "h")).alias("least"), F.count("*").alias("copies"), F.max("n").alias("n")), "jaccard-nodes")
    pairs = settle(_candidates(_postings(rows.select("text"), blocks, frequent), FREQUENT), "jaccard-pairs")
    classes = settle(components(pairs), "jaccard-classes")
    drop(pairs)
    large = settle(classes.groupBy("root").agg(F.count("*").alias("m")).where(F.col("m") >= LARGE).select("root"), "jaccard-large")
    if not large.isEmpty():
        held = classes.join(if_small(large), "root")
        again = settle(nodes.join(held.select(F.col("node").alias("sig")).unionByName(large.select(F.col("root").alias("sig"))), "sig").select("row"), "jaccard-again")
        body = rows.select(row, "text").join(if_small(again), "row", "left_semi").select("text")
        more = max(1, (body.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // AGAIN_BYTES)
        finer = components(settle(_candidates(_postings(body, blocks, frequent, more), HOT), "jaccard-pairs"))
        classes = settle(classes.join(if_small(large), "root", "left_anti").select("node", "root").unionByName(finer), "jaccard-classes")
    wanted = settle(_dealt_to_blocks(nodes.drop("least"), classes), "jaccard-wanted")
    blocked = _sets(rows.select(row, "text"), wanted).withColumn("other", F.explode("others")).select("class", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "sig", "copies", "own")
    verified = settle(_verified(blocked), "jaccard-links")
    drop(wanted)
    roots = components(verified.where("sig <> root").select(F.col("sig").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("sig").agg(F.sum("links").alias("links"))
    labelled = nodes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").join(links, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    told = labelled.where("copies > 1 or links > 0")
    least = told.groupBy("root").agg(F.min("least").alias("kept"))
    known = settle(told.join(least, "root").select("sig", F.col("kept.key").alias("component"), F.col("kept.h").alias("kept_h"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-known")
    component = F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component"))
    return entries.join(if_small(known), "sig", "left").select("key", "h", "n", component.alias("component"), "kept_h", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, n_shingles, component_id and n_links.

    component_id is the smallest key that links reach, the document's own included; n_links the number of documents
    that it links with, copies counted. Null, empty and blank texts have no n-grams and link with nothing. Repeated
    rows and equal texts link with each other; null keys are passed over in component_id, which is null where a class
    has no other. An empty table gives no rows.
    """
    return _classes(docs, key, text).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, its columns as they are, with one document of each class of linked ones: that of the smallest key.

    Null keys come last; of different texts with that key the one with the smallest hash stays, and of rows with one key
    and text one. Rows without n-grams are in no class.
    """
    found = settle(_classes(docs, key, text), "jaccard-found")
    gone = found.where("kept_h is not null and not (key <=> component and h = kept_h)").select(F.col("key").alias("gone_key"), F.col("h").alias("gone_h")).distinct()
    twice = settle(found.groupBy("key", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("gone_key"), F.col("h").alias("gone_h")), "jaccard-twice")
    row = F.col("row")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).cast("long").alias("own_key"), F.xxhash64(text).alias("own_h"))
    same = F.col("own_key").eqNullSafe(F.col("gone_key")) & (F.col("own_h") == F.col("gone_h"))
    kept = rows.join(if_small(gone), same, "left_anti")
    if not twice.isEmpty():
        repeated = if_small(twice)
        kept = kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["own_key", "own_h"]))
    return kept.select(row).select("row.*")
