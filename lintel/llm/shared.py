"""Helpers that the training-data operators share: tables that cut lineage, lookups and small Column idioms."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of a plain word.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
#: Most rows of a key table that is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder of the context.

    Where both are unset, a temporary folder serves a local session, whose tasks are on this machine; elsewhere that is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lintel-checkpoint-")
        context.setCheckpointDir(folder)
        return context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return the written table: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._settled = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more: what was made from them must have been settled in turn."""
    for table in tables:
        if spark := _written.pop(table._settled, None):
            _delete(spark, table._settled)


def forget() -> None:
    """Delete the tables that settle() wrote and that are still there; called at exit."""
    while _written:
        path, spark = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; what is left lies in the checkpoint folder
            return


atexit.register(forget)


def if_small(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """keys, marked for broadcast only if its counted rows are within the limit; a shuffled join otherwise."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def beside(names: list[str], results: tuple[str, ...]) -> list[str]:
    """Names for input columns beside result columns: one that a result has, in any case, gets _in behind it until it is its own."""
    taken, out = {r.lower() for r in results}, []
    for name in names:
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def plain_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN, -1))


def n_plain_words(text: Column) -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+ of a text, without an array for words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
