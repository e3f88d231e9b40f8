"""The pipeline's stages in turn, against what each promises."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from siftline.llm import packing, pii, toxicity
from siftline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "PII", "packing"]
    now, seen = docs.cache(), {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (now, out := stage(spark, now, SF).cache())
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        now = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["toxicity"]
    verdict = {r.doc_id: r.predicted for r in toxicity.toxicity(before, toxicity.train(before, labels)).collect()}
    assert ids(after) == {d for d, p in verdict.items() if not p}
    before, after = seen["line dedup"]
    assert ids(before) == ids(after)
    left = [x for r in after.collect() for x in r.text.split("\n") if x.strip()]
    there = {x for r in before.collect() for x in (r.text or "").split("\n")}
    assert len(left) == len(set(left)) and set(left) <= there and after.filter(F.length("text") != F.col("n_chars")).count() == 0
    before, after = seen["SimHash near-dedup"]
    texts = [r.text for r in after.collect()]
    assert ids(after) <= ids(before) and len(texts) == len({" ".join(t.lower().split()) for t in texts})
    before, after = seen["PII"]
    assert ids(before) == ids(after) and not any(pii.base_spans(r.text) for r in after.collect())
    assert after.filter(F.length("text") != F.col("n_chars")).count() == 0
    before, after = seen["packing"]
    bpe = packing.WordBPE(public_tokenizers.path("word_bpe_49k.json"), 1)
    assert {r.doc_id: len(bpe.encode_batch([r.text])[0]) // 4 for r in before.collect()} == {r.doc_id: r.doc_tokens for r in after.collect()}


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
