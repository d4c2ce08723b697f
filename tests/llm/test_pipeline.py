from __future__ import annotations

import corpus_pipeline
import pytest

from lintel.llm import packing, quality, queries

from .conftest import SCHEMA, odd_rows
from .test_decontaminate import brute as contamination
from .test_jaccard import brute as classes
from .test_packing import encode, unpacked


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """A small documents table with copies, benchmark passages, junk and odd rows."""
    at = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    item = bench.first()["text"]
    rows = [(10_000 + i, t, "en", s, 1) for i, t, _, s, *_ in odd_rows() if i is not None] + [(20_000, "The of and to in is " + item, "en", "src0", 1)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{at}/documents.parquet")
    bench.write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    at = docs
    good = {r["doc_id"]: r["text"] for r in quality.assess(docs).where("quality.kept").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in at.select("doc_id", "text").collect()]
        out = stage(spark, at, folder)
        if name == "quality_rules":
            assert {r["doc_id"] for r in out.collect()} == set(good)
        elif name == "near_duplicates":
            assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, c, _ in classes(before)})
        elif name == "decontamination":
            left = {r["doc_id"] for r in out.collect()}
            assert left == {i for i, t in before if not (lambda n, hit, _: hit > 0 and 20 * hit >= n)(*contamination(t, items))}
            assert 20_000 not in left
        elif name == "source_mix":
            assert {r["doc_id"] for r in out.collect()} <= {i for i, _ in before}
        else:
            twice = {}
            for i, t in before:
                twice.setdefault(i, []).append(t)
            got = unpacked(out.collect(), packing.ROW_TOKENS)
            assert {i: len(x) for i, x in got.items()} == {i: sum(len(encode(t)) + 1 for t in ts) for i, ts in twice.items()}
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{name}")
            at = spark.read.parquet(f"{folder}/{name}")


def test_run_is_the_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == spark.createDataFrame([], packing.SCHEMA).columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "source_mix", "packing"]


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("op2_shard_by_splitters", "op5_ngram_jaccard_join", "op10_mix_sources"):
        assert queries.queries()[name](spark, str(tmp_path)).count() == 0
