"""The registered queries against SQL and the pipeline against its operators' brute force."""

import itertools
import os
import re
import sys

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from pairwright.llm.oracle import ORACLE  # noqa: E402
from pairwright.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == []


def test_all_operators_are_registered():
    from __spark_entry__ import queries

    names = [re.match(r"op(\d+)_", n) for n in queries()]
    assert sorted(int(m[1]) for m in names if m) == list(range(1, 14)) and "pipeline" in queries()


def test_pipeline_equals_brute_force(spark):
    from test_joins import classes, grams, hits
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    toxic = {r.doc_id for r in QUERIES["op9_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert clean == set(docs) - toxic
    sets = {k: grams(docs[k].text) for k in clean}
    links = [(a, b) for a, b in itertools.combinations(sorted(clean), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    first = {k for k, c in classes(clean, links).items() if k == c}
    left = {d for d, _, n, _ in hits([(k, docs[k].text) for k in first], bench, 10) if n == 0}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == left
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in QUERIES["op10_secret_scan"](spark, SF).collect()}
    for k, r in got.items():
        assert r.n_tokens == len(library.encode(r.decoded, add_special_tokens=False).ids) and (r.source, r.lang) == (docs[k].source, docs[k].lang)
        assert (r.decoded == docs[k].text) == (found[k].spans == "")


def test_stages_keep_odd_rows(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here", "en", "s", 10), (None, None, None, None, None), (3, "two words", "en", "s", 9), (3, "two words", "en", "s", 9)]
    docs = spark.createDataFrame(rows, schema).withColumn("n_words", F.lit(1)).withColumn("score", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.columns == [*schema.names, "n_words", "score"]
    assert sorted(map(str, (r.doc_id for r in docs.collect()))) == ["1", "2", "3", "None", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 5


def test_stages_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
