import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from nestflow.llm import mixing, toxicity

from .helpers import DOCS, ODD, docs, tokens
from .test_decontam import brute as windows
from .test_neardup import brute as groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs(spark).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(1, 30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ODD[0][1]), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_on_odd_tables(spark, odd):
    for name, f in corpus_pipeline.STAGES:
        for d in (docs(spark), docs(spark, ODD[:0]), docs(spark, extra=True)):
            got = f(spark, d, odd)
            got.count()
            if name != "token_store":
                assert got.columns == d.columns
    assert corpus_pipeline.run(spark, odd).count() >= 0


def test_each_stage_against_brute_force(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda rs: sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rs)
    before = docs_.collect()
    score = {r.doc_id: r.score for r in toxicity.report(docs_, labels).collect()}
    stages = dict(corpus_pipeline.STAGES)
    df = stages["toxicity"](spark, docs_, SF)
    after = df.collect()
    assert key(after) == key(r for r in before if score[r.doc_id] < 0.5) and len(after) > 0.8 * len(before)

    before, df = after, spark.createDataFrame(after, DOCS)
    after = stages["near_duplicates"](spark, df, SF).collect()
    keep = {i for i, _, c in groups(before, 5) if i == c}
    assert key(after) == key(r for r in before if r.doc_id in keep)

    before, df = after, spark.createDataFrame(after, DOCS)
    after = stages["decontamination"](spark, df, SF).collect()
    bad = {r[0] for r in windows(before, [tuple(r) for r in bench.collect()]) if r[5]}
    assert key(after) == key(r for r in before if r.doc_id not in bad) and bad

    before, df = after, spark.createDataFrame(after, DOCS)
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    after = stages["source_mix"](spark, df, SF).collect()
    assert key(after) == key(r for r in before for _ in range(copies[r.doc_id]))
    assert abs(sum(len(tokens(r.text)) for r in after) / sum(len(tokens(r.text)) for r in before) - 1.5) < 0.1

    got = stages["token_store"](spark, spark.createDataFrame(after, DOCS), SF).collect()
    tok, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(after, key=lambda r: (r.doc_id, r.text)):
        ids = tok.encode(r.text, add_special_tokens=False).ids + [0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got)) == sorted(want)
