"""The pipeline, stage by stage on its own input, and the registered queries against DuckDB."""

import public_tokenizers
import pytest
from oracle import compare, connect

import corpus_pipeline
from __spark_entry__ import queries
from creditloom.llm import bpe, jaccard, mixing
from creditloom.llm.queries import REGISTRY
from test_llm_repeats import classes, windows_removed

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "encoding":
            assert docs.columns == columns
    toxic = [r.doc_id for r in seen["toxicity"]]
    assert len(toxic) == len(set(toxic)) and set(toxic) <= before.keys() and len(toxic) > 0.85 * len(before)
    rows = [(r.doc_id, r.text) for r in seen["toxicity"]]
    assert {r.doc_id for r in seen["jaccard"]} == {i for i, _, c in classes(rows) if i == c}
    cut = {i: (lost, text) for i, _, lost, text in windows_removed([(r.doc_id, r.text) for r in seen["jaccard"]])}
    for r in seen["passages"]:
        assert r.text == (cut[r.doc_id][1] if cut[r.doc_id][0] else before[r.doc_id].text)
    passages = spark.read.parquet(str(tmp_path / "passages"))
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(passages).collect()}
    emitted = [r.doc_id for r in seen["mixing"]]
    assert all(emitted.count(i) * size == words for i, (size, words) in taken.items())
    encode, _ = bpe.coder(public_tokenizers.path(corpus_pipeline.TOKENIZER), public_tokenizers.PATTERN)
    ids = {r.doc_id: list(encode(r.text)) for r in seen["passages"]}
    assert len(seen["encoding"]) == len(emitted) and all(r.ids == ids[r.doc_id] and r.n_tokens == len(r.ids) for r in seen["encoding"])


def test_run(spark):
    assert queries()["pipeline"](spark, SF).count() > 100
    assert jaccard.PERCENT == 75 and jaccard.SHINGLE == 5


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_sql(spark, name):
    _, fault = compare(REGISTRY[name].run(spark, SF), connect(SF), REGISTRY[name].sql)
    assert fault is None
