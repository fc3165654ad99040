"""The whole corpus pipeline over the smallest tables."""

import re

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_run_drops_what_its_stages_reject(spark):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in rows}
    assert rows and kept < documents.keys() and all(0 <= r.shard < 16 for r in rows)
    # Slots are gapless in every shard.
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    # Of texts with the same words one stays, and no benchmark passage of ten words is left.
    words = [tuple((documents[d] or "").split()) for d in kept]
    assert len(set(words)) == len(words)
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    grams = lambda w: {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    banned = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        banned |= {g for g in grams(cut(item.text)) if len(g) == 10}
    assert not any(grams(cut(documents[d])) & banned for d in kept)
