"""Hot ids, bounds, large families and the models against plain arithmetic."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import scratch
from strandloom.llm import labelled, langid, packing, phrase_prints, quality, shingle_join, token_files, toxicity
from strandloom.llm.queries import tokenizer_file
from tests.llm.test_operators import copies_of, plain_components

SMALL = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_large_families_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK_DOCS", 12)
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(400)]
    seeds = [" ".join(random.choices(vocabulary, k=130)) for _ in range(4)]
    texts = copies_of(seeds[:1], 150, 5, vocabulary)
    #: A chain in which each text is near the one before alone, and halves that two groups share.
    now = seeds[1].split()
    for k in range(40):
        now[3 * k % 120] = random.choice(vocabulary)
        now[(3 * k + 60) % 120] = random.choice(vocabulary)
        texts.append(" ".join(now))
    both = " ".join(random.choices(vocabulary, k=125))
    texts += [f"{both} {random.choice(vocabulary)} {random.choice(vocabulary)} {t}" for t in copies_of(["a b c d e f g h"], 60, 6, vocabulary)]
    random.shuffle(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.jaccard_components(d, words=3, num=8, den=10).collect()}
    assert got == plain_components(list(enumerate(texts)), 3, 8, 10)


def test_repeated_rows_and_clashing_columns(spark):
    random.seed(12)
    vocabulary = [f"w{i}" for i in range(300)]
    base = " ".join(random.choices(vocabulary, k=150))
    near = " ".join([*base.split()[:-2], "x", "y"])
    rows = [(7, base)] * 20 + [(9, near), (3, "other words entirely here"), (None, base)]
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, _gone int, family int, component int")
    got = {(r.doc_id, r.component_id) for r in shingle_join.jaccard_components(d).collect()}
    assert got == {(7, 7), (9, 7), (3, 3), (None, None)}
    kept = shingle_join.keep_one(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["7"] * 20 + ["3", "None"])


def test_one_id_of_many_rows(spark):
    d = spark.range(5_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")
    s = scratch.Scratch(spark, "test")
    some = labelled.labelled_sample(d, labels, label_col="quality", per_class={0: 10, 1: 10})
    assert some.count() == 5_000
    f = some.select("doc_id", "y", F.col("text").cast("binary").alias("idx"))
    assert labelled.bounded(s, f, {0: 10, 1: 10}).count() == 10
    same = d.select("doc_id", F.lit("one text").alias("text"))
    assert labelled.labelled_sample(same, labels, label_col="quality", per_class={0: 10, 1: 10}).count() == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps small partitions apart
    m, folder = token_files.write_token_files(d.where("text < 'text 2'"), tokenizer_file("byte_bpe_50k.json"), 2, shard_bytes=1_000)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len({r.part for r in m.collect()}) > 1
    read = token_files.read_token_files(m, folder).orderBy("start").collect()
    assert [r.start for r in read] == np.cumsum([0, *(r.n_tokens for r in read[:-1])]).tolist()


def test_ids_above_the_width_are_an_error():
    ids = np.array([1, 70_000], "<u4").tobytes()
    with pytest.raises(ValueError, match="70000"):
        token_files._narrow(ids, 2)
    assert token_files._narrow(ids, 4) == ids


def test_prints_of_one_id_of_many_rows(spark):
    random.seed(13)
    rows = [(5 if k % 3 else k, "".join(random.choices("abcd ", k=30))) for k in range(300)] + [(None, None)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string")
    h = [r.h for r in d.select(F.xxhash64("text").alias("h")).collect()]
    order = sorted(range(len(rows)), key=lambda k: (-(1 << 63) if rows[k][0] is None else rows[k][0], h[k]), reverse=True)
    want = []
    for a, b in zip(order, [*order[1:], order[0]]):
        t, nxt = rows[a][1] or "", rows[b][1] or ""
        n = len(t)
        edited = t[: n - n // 3] + nxt[: n // 3]
        want.append((str(rows[a][0]), n, hashlib.sha256(edited.encode()).hexdigest(), round(phrase_prints.likeness(phrase_prints.signature(t), phrase_prints.signature(nxt)), 9)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_next, 9)) for r in phrase_prints.with_edits(d, bucket_rows=10).collect()]
    assert sorted(got) == sorted(want)


def test_phrases_go_on_over_stretches(monkeypatch):
    random.seed(14)
    t = "".join(random.choices("ab", k=4_000))
    whole = phrase_prints.signature(t)
    monkeypatch.setattr(phrase_prints, "LONG", 300)
    assert phrase_prints.signature(t).tolist() == whole.tolist()
    monkeypatch.setattr(phrase_prints, "PHRASES", 50)
    assert phrase_prints.signature(t).tolist() != whole.tolist()


def test_no_shared_folder_is_an_error():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_root(Session)


def plain_grams(text):
    """1- to 3-grams of a text as the language model sees it: letters, and one space for each run of others."""
    s = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    return [s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1)]


def test_language_is_naive_bayes(spark):
    texts = [("the cat sat on the mat", "en"), ("le chat est ici", "fr"), ("the dog", "en"), ("der Hund ist da!", "de"), ("un chien", "fr")]
    model = langid.fit(spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id long, text string, lang string"))
    #: The buckets of the n-grams, so that collisions are the model's own.
    bucket = {}
    for g in {g for t, _ in [*texts, ("a cat ist le 12 zz", ""), ("the Hund", "")] for g in plain_grams(t)}:
        (points, own, skip), *_ = langid.blocks([g])
        bucket[g] = [h for h, _ in langid.grams(points, own, skip[0])][len(g) - 1][0]
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for t, lang in texts:
        docs[lang] += 1
        counts[lang].update(bucket[g] for g in plain_grams(t))
    for t in ("a cat ist le 12 zz", "the Hund"):
        score = {}
        for lang, c in counts.items():
            total = sum(c.values()) + 0.5 * langid.BUCKETS
            score[lang] = math.log(docs[lang] / len(texts)) + sum(math.log((c[bucket[g]] + 0.5) / total) for g in plain_grams(t))
        best = max(score, key=score.get)
        at, p = langid.score([t], model)
        assert model[0][at[0]] == best
        assert p[0] == pytest.approx(1 / sum(math.exp(v - score[best]) for v in score.values()), rel=1e-3)


def test_updates_follow_the_regularised_leader():
    rng = np.random.default_rng(3)
    size = 1 << quality.BITS
    examples = [(np.r_[np.sort(rng.choice(40, 6, replace=False)), size].astype(np.int32), np.r_[rng.random(6), 1.0], int(rng.integers(2)), float(rng.random() + 0.5)) for _ in range(50)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 1e-4
    w, bias = quality.ftrl(examples, 3, alpha, beta, l1, l2)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for idx, val, y, k in examples:
            now = {i: weight(i) for i in idx.tolist()}
            p = 1 / (1 + math.exp(-sum(now[i] * v for i, v in zip(idx.tolist(), val))))
            for i, v in zip(idx.tolist(), val):
                g = (p - y) * k * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * now[i]
                n[i] += g * g
    assert all(w[i] == pytest.approx(weight(i), abs=1e-9) for i in range(40)) and bias == pytest.approx(weight(size), abs=1e-9)


@pytest.mark.parametrize("y", [0, 1])
def test_noisy_or_gradient(y):
    s = np.array([-2.0, 0.5, -4.0])

    def loss(s):
        p = toxicity.noisy_or(1 / (1 + np.exp(-s)))
        return -math.log(p if y else 1 - p)

    p = 1 / (1 + np.exp(-s))
    got = toxicity.pulls(s, y)
    for k in range(3):
        h = np.zeros(3)
        h[k] = 1e-6
        assert got[k] == pytest.approx((loss(s + h) - loss(s - h)) / 2e-6, rel=1e-4)
    assert len(p) == len(got)


def test_held_out_recall_and_precision(spark):
    docs, labels = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    for module, label, at in ((toxicity, "toxic", 0.3), (quality, "quality", 0.5)):
        model = module.fit(docs, labels, fold=fold)
        got = module.predict(docs.where(~fold), model).join(labels, "doc_id").where(f"{label} is not null").select("score", label).collect()
        hit = sum(r.score >= at and r[label] == 1 for r in got)
        assert hit / sum(r[label] == 1 for r in got) >= 0.9 and hit / sum(r.score >= at for r in got) >= 0.85


def test_good_documents_stay_whole(spark):
    w = np.zeros(1 << quality.BITS, np.float32)
    f, _ = quality.features("junk")
    w[f] = -50.0
    d = spark.createDataFrame([(1, "junk", 1.0), (2, "fine words", 2.0), (None, None, 3.0), (4, "", 4.0), (2, "fine words", 2.0)], "doc_id long, text string, score double")
    kept = quality.keep_good(d, (w, 0.0))
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "4", "None"]


def test_packed_ids_are_the_library_s(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SMALL, "documents")
    rows = packing.pack(docs, tokenizer_file("word_bpe_49k.json"), 2, keep_ids=True).collect()
    t, pieces = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    for r in docs.collect():
        want = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(x for _, x in sorted(pieces[r.doc_id])) == want
    n = 1 + max(r.sequence_id for r in rows)
    assert sum(r.length for r in rows) >= 0.99 * 4096 * n
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)


def test_unlike_texts_of_one_id(spark):
    random.seed(15)
    vocabulary = [f"w{i}" for i in range(300)]
    a, b, c = (" ".join(random.choices(vocabulary, k=80)) for _ in range(3))
    d = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (5, c + " z")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in shingle_join.jaccard_components(d).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
