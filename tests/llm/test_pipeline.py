"""The corpus pipeline from end to end on a small corpus with planted rows, and each stage against a plain version."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from strandloom.llm import quality, toxicity
from strandloom.llm.queries import tokenizer_file
from tests.llm.test_operators import plain_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, family string, _gone int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    good, bad, rude = ([f"{k}{i}" for i in range(120)] for k in ("fine", "junk", "scum"))
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(bad if i % 4 == 1 else good, k=rng.choice([30, 80, 200]))
        if i % 4 == 2:
            words[5:8] = [*rng.choices(rude[:3], k=2), "."]
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(i % 4 != 1), int(i % 4 == 2)))
    rows += [(300 + k, rows[4 * k][1]) for k in range(20)] + [(330 + k, rows[4 * k + 3][1] + " finely added") for k in range(20)]
    rows += [(400, None), (401, ""), (402, "fine1 " * 60_000), (None, rows[0][1]), (4, rows[4][1]), (403, "fine1 fine2")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", None, "x", 1) for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_against_plain_versions(spark, corpus):
    from tokenizers import Tokenizer

    folder, rows = corpus
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    got = [(name, f(spark, docs, folder)) for name, f in corpus_pipeline.STAGES[:1]]
    key = lambda x: sorted((str(r.doc_id), r.text) for r in x.collect())
    model = toxicity.fit(docs, labels)
    weights = toxicity._Weights(model)
    left = [r for r in rows if toxicity.noisy_or(toxicity.sentence_scores(r[1], weights, model[1])) < 0.3]
    assert got[0][1].columns == docs.columns and sorted((str(i), str(t)) for i, t in left) == sorted((str(r.doc_id), str(r.text)) for r in got[0][1].collect())
    assert not {i for i, _ in left if i is not None and i < 240} & set(range(2, 240, 4)) and len(left) > 180
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x", 1) for i, t in left], DOCS)
    model = quality.fit(docs, labels)
    left = [r for r in left if quality.score(r[1], model) >= 0.5]
    step = corpus_pipeline.STAGES[1][1](spark, docs, folder)
    assert sorted((str(i), str(t)) for i, t in left) == sorted((str(r.doc_id), str(r.text)) for r in step.collect())
    assert not {i for i, _ in left if i is not None and i < 240} & set(range(1, 240, 4))
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x", 1) for i, t in left], DOCS)
    comp = plain_components([r for r in left if r[0] is not None], 5, 8, 10)
    left = [r for r in left if r[0] is None or comp[r[0]][1] == r[0]]
    step = corpus_pipeline.STAGES[2][1](spark, docs, folder)
    assert step.columns == docs.columns and sorted((str(i), str(t)) for i, t in left) == sorted((str(r.doc_id), str(r.text)) for r in step.collect())
    assert len(left) < len(comp) - 30
    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in left)
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x", 1) for i, t in left], DOCS)
    packed = corpus_pipeline.STAGES[3][1](spark, docs, folder).collect()
    assert sum(r.length for r in packed) == want
    full = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in full) == sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in packed)
    used = np.bincount([r.sequence_id for r in full], [r.length for r in full])
    assert used.max() <= 4096 and key(docs)


def test_nothing_to_do(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/b/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/b/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, f"{tmp_path}/b").count() == docs.count()
