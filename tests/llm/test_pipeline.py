"""Each stage of the pipeline against a plain version on its own input."""

from __future__ import annotations

import corpus_pipeline as pipeline
from ledgerlens.llm import line_quality, personal_data
from tests.llm.conftest import TINY
from tests.llm.test_set_operators import brute_components, brute_contamination, brute_fingerprint


def test_stages_do_what_they_say(spark, tiny, tmp_path):
    docs, items = tiny("documents"), [(r["item_id"], r["text"]) for r in tiny("benchmark").collect()]
    seen = {}
    for name, stage in pipeline.STAGES:
        seen[name] = docs
        out = stage(spark, docs, TINY)
        if name != "sequences":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    after = {name: {r["doc_id"]: r["text"] for r in d.collect()} for name, d in seen.items()}
    model = line_quality.train(seen["quality"], tiny("labels"))
    good = {i: t for i, t in after["quality"].items() if line_quality.document_score(t, model) >= 0.7}
    assert after["near_duplicates"] == good
    labels = brute_components({i: brute_fingerprint(t) for i, t in good.items()})
    assert after["benchmark"] == {i: t for i, t in good.items() if labels[i] == i}
    clean = {d for d, *_, bad in brute_contamination(after["benchmark"].items(), items) if not bad}
    assert after["private"] == {i: t for i, t in after["benchmark"].items() if i in clean}
    assert after["sequences"] == {i: personal_data.redact(t, personal_data.find(t)) for i, t in after["private"].items()}
    assert {i for r in docs.collect() for i in r["doc_ids"]} == clean
    assert sum(r["n_tokens"] for r in docs.collect()) == sum(len(t.split()) for t in after["sequences"].values())


def test_stages_take_odd_rows(spark, documents):
    odd = documents([(None, None), (1, ""), (1, ""), (2, "a@b.co " * 300), (3, None)], "score", "component_id", "digest")
    for _, stage in pipeline.STAGES:
        stage(spark, odd, TINY).collect()
        stage(spark, odd.limit(0), TINY).collect()
