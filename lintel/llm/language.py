"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams, in order. A document's own list is compared with
each profile by the out-of-place distance: the sum, over the document's n-grams, of how far each stands from its place
in the profile, or the full length where the profile lacks it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_batches
from .shared import beside, drop, settle

#: N-grams in a profile and in a document's list.
TOP = 400
#: About so many training documents of each language are drawn by a hash; all where there are fewer.
SAMPLE = 2_000
#: Labels that are learnt at most, those with the most rows first: more than there are language codes. Profiles take 3 KB each in every task.
LANGUAGES = 8_192
UNKNOWN = "und"

Profiles = list[tuple[str, list[int]]]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def n_grams(text: str) -> np.ndarray:
    """Codes of the 1-, 2- and 3-grams of a text's words, in lower case, with one blank (0) on either side of a word."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 0).astype(np.uint64)
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    if len(points) < 3:
        return np.empty(0, np.uint64)
    shift, high, low = np.uint64(21), np.uint64(1 << 63), np.uint64(1 << 62)
    two = (points[:-1] << shift) | points[1:]
    three = (two[:-1] << shift) | points[2:]
    return np.concatenate([points[points != 0] | high | low, two | high, three[points[1:-1] != 0]])


def _ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes; those equally frequent by code."""
    values, counts = np.unique(codes, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:top]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", draw: str = "doc_id", top: int = TOP, sample: int = SAMPLE) -> Profiles:
    """(language, its n-gram codes in order) of each language of the labelled rows; rows without text or label are left out.

    sample bounds the rows of a language that are counted, in expectation: they are drawn by a hash of the draw column.
    Of more than LANGUAGES labels, those with the most rows are learnt, of equals the first by name.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(F.col(draw), F.lit("language")), F.lit(1 << 30)).alias("h"))
    sizes = settle(rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES), "language-sizes")
    under = F.least(F.lit(1.0), sample / F.col("n")) * (1 << 30)
    drawn = rows.join(F.broadcast(sizes), "lang").where(F.col("h") < under).select("lang", "text")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            langs = np.array(batch.column(0).to_pylist(), object)
            bodies = batch.column(1).to_pylist()
            out: list[tuple[str, np.ndarray, np.ndarray]] = []
            for name in sorted(set(langs)):
                codes = [n_grams(bodies[i]) for i in np.flatnonzero(langs == name)]
                out.append((name, *np.unique(np.concatenate(codes), return_counts=True)))
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]).tolist(), pa.string()), pa.array(np.concatenate([x[1] for x in out]).view(np.int64)), pa.array(np.concatenate([x[2] for x in out]))], ["lang", "code", "n"])

        return each

    counted = map_batches(drawn, "lang string, code long, n long", make).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # of equals the lower code first, as unsigned numbers, as in a document's own list
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("code").bitwiseXOR(F.lit(-(1 << 63)))))
    best = counted.withColumn("place", place).where(F.col("place") <= top).collect()
    drop(sizes)
    known: dict[str, list[tuple[int, int]]] = {}
    for r in best:
        known.setdefault(r["lang"], []).append((r["place"], r["code"]))
    return [(name, [code for _, code in sorted(known[name])]) for name in sorted(known)]


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", carry: tuple[str, ...] = ("doc_id",), top: int = TOP) -> DataFrame:
    """carry columns of docs, with lang_pred and score.

    lang_pred is the language of the least distance, the first by name of equals; score is 1 minus the distance as a
    part of the largest. A text that is null, empty or without letters, or an empty set of profiles, gives `und` and 0.
    Whole texts are read, whatever their length; each row is judged alone, so repeated rows give repeated results. A
    carried column called lang_pred or score, in any case, gets _in behind it.
    """
    inner = docs.select(*carry, docs[text]).toDF(*beside([*carry], ("lang_pred", "score", "__text")), "__text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1]), "lang_pred string", "score double"])
    shipped = profiles

    def make():
        tables = []
        for name, codes in shipped:
            values = np.array(codes, np.int64).view(np.uint64)
            order = np.argsort(values)
            tables.append((name, values[order], order))

        def judge(body: str | None) -> tuple[str, float]:
            codes = n_grams(body) if body else np.empty(0, np.uint64)
            if not len(codes) or not tables:
                return UNKNOWN, 0.0
            own = _ranked(codes, top)
            places = np.arange(len(own))
            best, least = UNKNOWN, None
            for name, values, rank in tables:
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                apart = np.where(values[at] == own, np.abs(rank[at] - places), top)
                if least is None or apart.sum() < least:
                    best, least = name, int(apart.sum())
            return best, 1.0 - min(1.0, least / (top * len(own)))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [judge(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

        return each

    return map_batches(inner, schema, make)
