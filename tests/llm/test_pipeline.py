"""Each stage of the pipeline against a brute-force version, on a small table."""

import corpus_pipeline
import pytest

from loglattice.llm import packing, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{base}/{k}")
        out.append(spark.read.parquet(f"{base}/{k}"))
    return out


def test_stages(spark, stages):
    docs, clean, exact, near, mixed, packed = stages
    assert all(s.columns == docs.columns for s in stages[1:5])
    text = {x.doc_id: x.text for x in docs.collect()}
    kept = {x.doc_id for x in clean.collect()}
    labels = {x.doc_id: (x.quality, x.toxic) for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [k for k, v in labels.items() if v == (1, 0)]
    assert sum(k in kept for k in good) > 0.9 * len(good)
    assert sum(k in kept for k, v in labels.items() if v[0] == 0) <= 2
    first = {}
    for k in sorted(kept):
        first.setdefault(" ".join(text[k].split()), k)
    assert {x.doc_id for x in exact.collect()} == set(first.values())
    alone = {x.doc_id for x in near.collect()}
    assert alone <= set(first.values())

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}

    sets = {k: grams(text[k]) for k in first.values()}
    for k in set(first.values()) - alone:  # what went is like something
        assert any(len(sets[k] & s) >= 0.45 * len(sets[k] | s) for j, s in sets.items() if j != k)
    for k in alone:  # nothing much alike stays
        assert not any(len(sets[k] & sets[j]) >= 0.9 * len(sets[k] | sets[j]) for j in alone if j < k and min(len(sets[j]), len(sets[k])) > 20)
    assert mixed.count() == near.count() and {x.doc_id for x in mixed.collect()} <= alone
    enc, _ = tokens.encoder(tokens.VOCABULARY)
    rows = packed.collect()
    assert sum(len(x.tokens) for x in rows) == sum(len(enc.encode_ordinary(x.text)) for x in mixed.collect())
    assert all(len(x.tokens) <= x.capacity <= packing.CAPACITIES[-1] for x in rows)
    assert {i for x in rows for i in x.doc_ids} == {x.doc_id for x in mixed.collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
