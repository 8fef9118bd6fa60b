"""The training-data operators against brute force, round trips and held-out labels, with the odd cases of a table."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import grid_join, langid, packing, phrase_prints, pieces, quality, shingle_join, token_files, toxicity, warc, words
from strandloom.llm.queries import tokenizer_file
from strandloom.operators.components import connected_components

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark, texts):
    """Rows with a null id, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", None, 1, "x") for i, t in enumerate(texts)] + [(None, "no id at all", None, None, None, 2, "y")]
    return spark.createDataFrame(rows, SCHEMA + ", n long, node string")


def unlike(a, b):
    return [x for x in a if x not in b]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    random.seed(5)
    parts = list("ab ZÉ.'\n\t \x1c\x85éİΣßA1½²’ 　") + ["  ", "'ll", "<|endoftext|>", "don't", "the ", " of\n", "!!"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(4000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e, t = words.Encoder(tokenizer_file(name)), Tokenizer.from_file(tokenizer_file(name))
        assert e.kind != "whole"
        for x, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(e(x), "<u4").tolist() == want.ids, x


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["one two three", "", None, "one two three", "long " * 30_000, "Äpfel\n\nund <|endoftext|>"]
    manifest, folder = token_files.write_token_files(odd_docs(spark, texts), tokenizer_file("byte_bpe_50k.json"), 2, shard_bytes=64)
    got = token_files.read_token_files(manifest, folder).collect()
    t, at = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), 0
    want = []
    for i, x in [(None, "no id at all"), *enumerate(texts)]:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(((*r[:4],) for r in got), key=str) == sorted(want, key=str)
    found = [token_files.read_document(r.path, b"", 4) for r in manifest.collect()]  # too few rows for a dictionary
    assert [len(x) for x in found if x is not None] == [want[5][2]]
    empty, folder = token_files.write_token_files(odd_docs(spark, []).limit(0), tokenizer_file("byte_bpe_50k.json"), 2)
    assert token_files.read_token_files(empty, folder).count() == 0


def test_packing(spark):
    random.seed(2)
    texts = ["w " * random.choice([0, 1, 3, 50, 900, 5000, 4095, 4096]) for _ in range(60)] + [None]
    got = packing.pack(odd_docs(spark, texts), tokenizer_file("word_bpe_49k.json"), 2, keep_ids=True)
    rows = got.collect()
    assert sum(r.length for r in rows) == sum(len((t or "").split()) + 1 for t in texts) + 5
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for v in by_doc.values():
        assert sum(x[1] for x in v) == v[0][2] and sorted(v)[0][0] == 0
    assert sorted(by_seq) == list(range(len(by_seq)))
    for v in by_seq.values():
        ends = list(itertools.accumulate(x[1] for x in sorted(v)))
        assert [x[0] for x in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert packing.sequences(got).agg({"n_tokens": "sum"}).first()[0] == sum(r.length for r in rows)
    assert packing.pack(odd_docs(spark, []).limit(0), tokenizer_file("word_bpe_49k.json"), 2).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_shortest_pack_first_places_every_rank_once(seed):
    random.seed(seed)
    hist = {random.randint(1, 64): random.randint(1, 500) for _ in range(seed * 4 + 1)}
    if seed == 5:
        hist = {10: 1000}
    runs = packing.shortest_pack_first(hist, 64)
    used, seen = collections.defaultdict(int), collections.defaultdict(set)
    for length, rank, packs, copies, first, offset in runs.tolist():
        for p in range(packs):
            for c in range(copies):
                r = rank + p * copies + c
                assert r not in seen[length]
                seen[length].add(r)
                span = set(range(offset + c * length, offset + (c + 1) * length))
                assert max(span) < 64 and not (used[first + p] >> min(span)) & ((1 << length) - 1)
                used[first + p] |= ((1 << length) - 1) << min(span)
    assert {k: len(v) for k, v in seen.items()} == hist
    assert all(u & (u + 1) == 0 for u in used.values())


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 4 <> 2"))
    got = langid.predict(docs, model).join(docs, "doc_id").where("doc_id % 4 = 2")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert right >= 0.97 * n
    odd = {r.doc_id: r for r in langid.predict(odd_docs(spark, ["", None, "123 !!", "the and of", "é" * 700_000]), model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and odd[3].lang_pred == "en" and odd[4].lang_pred in ("fr", "es")
    assert all(0 <= r.score <= 1 for r in odd.values())
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_language_scores_by_plain_counting():
    texts = ["Ab, cd!", "x", "", "éé 1 a"]
    rng = np.random.default_rng(0)
    logp = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    best, p = langid.score(texts, (["a", "b", "c"], logp, np.zeros(3)))
    for i, t in enumerate(texts):
        one, q = langid.score([t], (["a", "b", "c"], logp, np.zeros(3)))
        assert one[0] == best[i] and abs(q[0] - p[i]) < 1e-9
    s = re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0].isalpha() else " ", "Ab, cd!".lower())
    s = re.sub(" +", " ", s)
    h = [x for pts, own, k in langid.blocks(["Ab, cd!"]) for x, _ in langid.grams(pts, own, k[0])]
    assert [len(x) for x in h] == [len(s), len(s) - 1, len(s) - 2]


def _auc(y, s):
    order = np.argsort(s)
    r = np.empty(len(s))
    r[order] = np.arange(1, len(s) + 1)
    y = np.array(y)
    return (r[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, module, label):
    docs, labels = (spark.read.parquet(f"{DATA.replace("0.001", "0.1")}/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels, fold=F.col("doc_id") % 3 != 1)
    got = module.predict(docs, model).join(labels, "doc_id").where("doc_id % 3 = 1").collect()
    assert _auc([r[label] for r in got], [r.score for r in got]) > 0.95
    odd = module.predict(odd_docs(spark, ["", None, "word " * 300_000, "a"]), model).collect()
    assert len(odd) == 5 and all(0 <= r.score <= 1 for r in odd)
    none = module.fit(docs, labels.limit(0))
    assert module.predict(docs, none).count() == docs.count()


def test_offending_sentences(spark):
    w = np.zeros(1 << toxicity.BITS)
    w[list(toxicity.word_features("scum"))] = 12.0
    d = odd_docs(spark, ["A good day. You scum! Yes.", None, ""])
    got = toxicity.offending_sentences(d, (w, -6.0)).collect()
    assert [(r.doc_id, r.sentence.strip(), r.start) for r in got] == [(0, "You scum!", 11)]
    assert {r.doc_id for r in toxicity.keep_clean(d, (w, -6.0)).collect()} == {1, 2, None}


def test_components(spark):
    random.seed(3)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1300)] + [(7, 7), (None, 3)]
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("kind,labels", [("string", ["a", "b", None]), ("double", [1.2, 1.7, None]), ("boolean", [True, False, None])])
def test_near_vectors_of_labels_of_any_type(spark, kind, labels):
    rows = [(k, [1.0, 0.01 * (k % 2), 0.0], labels[k % 3]) for k in range(30)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in grid_join.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    assert got == {k: (9, k % 3) if k % 3 < 2 else (0, k) for k in range(30)}


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    rows, base = [], rng.normal(size=(12, 6))
    for i in range(400):
        x = base[i % 12] + rng.normal(size=6) * rng.choice([0, 0.05, 0.6])
        rows.append((i, x.tolist(), int(i % 3) if i % 50 else None))
    rows += [(900, None, 1), (901, [0.0] * 6, 1), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (903, [float("nan")] * 6, 1), (904, [], 1), (5, rows[5][1], 2), (None, rows[4][1], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1)]
    got = grid_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    ok = [(k, i, np.array(v), label) for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, up = collections.Counter(), {i: i for _, i, _, _ in ok}

    def find(x):
        return x if up[x] == x else find(up[x])

    for (ka, i, a, la), (kb, j, b, lb) in itertools.combinations(ok, 2):
        if la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
            links[ka] += 1
            links[kb] += 1
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    want = sorted((str(i), links[k], str(find(i) if i in up else i)) for k, (i, _, _) in enumerate(rows))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want


def test_warc(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "http://a b", big), (3, "u", big), (9, None, big), (4, "u", None), (6, "u", "short"), (7, "u", "short"), (None, "u", big), (3, "u", big), (8, "u", "é" * 50), (2, "u", "é" * 50)]
    m = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), file_bytes=500)
    got = sorted(((*r,) for r in warc.read_archives(m).collect()), key=str)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        least = min((j for j, _, x in rows if x == h and j is not None), default=None) if len(p) >= 100 else i
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if i == least else "revisit", None if i == least else least))
    assert got == sorted(want, key=str)
    for r in m.collect():
        records = list(warc.records(r.path))
        assert len(records) == r.n_records and all(x.startswith(b"WARC/1.1\r\nWARC-Type: ") for x in records)


def plain_components(texts, k, num, den):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)}) if w else set()
    up = {i: i for i in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in itertools.combinations(sets, 2):
        inter = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies_of(texts, n, edits, vocabulary):
    out = []
    for _ in range(n):
        w = random.choice(texts).split()
        for _ in range(random.randint(0, edits)):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 8, 10)])
def test_shingle_join(spark, monkeypatch, k, num, den):
    random.seed(k)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(random.choices(vocabulary, k=60))
    fresh = [" ".join(random.choices(vocabulary, k=random.choice([1, 2, 4, 12, 80, 150]))) for _ in range(60)]
    family = [" ".join(random.choices(vocabulary, k=120))]
    chain = copies_of(family, 130, 4, vocabulary)
    shared = [f"{' '.join(random.choices(vocabulary, k=n))} {passage}" for n in [5, 40, 40, 200] * 25]
    texts = fresh + copies_of([t for t in fresh if len(t.split()) > 4], 60, 3, vocabulary) + chain + copies_of(chain, 60, 3, vocabulary) + shared
    texts += [fresh[0].upper(), "", "  \t\n", "one", "ONE", "a\xa0b c\x85d", None]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.jaccard_components(odd_docs(spark, texts), words=k, num=num, den=den).collect()}
    want = plain_components([*rows, (None, "no id at all")], k, num, den)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 80
    kept = {r.doc_id for r in shingle_join.keep_one(odd_docs(spark, texts), words=k, num=num, den=den).collect()}
    assert kept == {c for i, (_, c) in want.items()}


def test_shingle_join_of_little(spark):
    assert shingle_join.jaccard_components(odd_docs(spark, []).limit(0)).count() == 0
    assert shingle_join.jaccard_components(odd_docs(spark, ["a", "b"])).count() == 3


def plain_phrases(text):
    seen, now, out = set(), "", set()
    for c in text:
        now += c
        if now not in seen:
            seen.add(now)
            out.add(now)
            now = ""
    return out | ({now} if now else set())


def test_phrase_prints(spark):
    random.seed(4)
    texts = ["ab" * random.randint(0, 400) + "".join(random.choices("abcdé ", k=random.randint(0, 900))) for _ in range(70)] + [None, "", "same text", "same text"]
    d = odd_docs(spark, texts)
    got = {r.doc_id: r for r in phrase_prints.with_edits(d, bucket_rows=9).collect()}
    order = [*range(len(texts) - 1, -1, -1), None]
    text = {**dict(enumerate(t or "" for t in texts)), None: "no id at all"}
    for a, b in zip(order, [*order[1:], order[0]]):
        n = len(text[a])
        edited = text[a][: n - n // 3] + text[b][: n // 3]
        r = got[a]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        sig = phrase_prints.signature(text[a])
        assert r.fingerprint == phrase_prints.pack_signature(sig)
        assert r.edited_fingerprint == phrase_prints.pack_signature(phrase_prints.signature(edited))
        assert abs(r.near_next - phrase_prints.likeness(sig, phrase_prints.signature(text[b]))) < 1e-12
        if len(plain_phrases(text[a])) < phrase_prints.KEPT:
            assert len(sig) == len(plain_phrases(text[a]))
        x, y = plain_phrases(text[a]), plain_phrases(edited)
        if x | y:
            assert abs(r.near_edited - len(x & y) / len(x | y)) < 0.25
    assert phrase_prints.with_edits(d.limit(0)).count() == 0
    one = phrase_prints.with_edits(d.where("doc_id = 3")).first()
    assert one.near_next == 1.0
    assert phrase_prints.fingerprints(d).count() == len(texts) + 1


def test_long_texts_start_new_dictionaries(monkeypatch):
    monkeypatch.setattr(phrase_prints, "PHRASES", 64)
    monkeypatch.setattr(phrase_prints, "LONG", 64)
    t = "abcabcabd" * 50
    assert phrase_prints.signatures(t, 300, t[:150])[0].tolist() == phrase_prints.signature(t).tolist()


def test_pieces(spark):
    p = pieces.Pieces(tokenizer_file("piece_bpe_32k.model"))
    assert p.by_word and p.plan["model_type"] == pieces.BPE
    random.seed(6)
    parts = list("abc é\n\t.▁1") + ["  ", " the", "ß", "日本", "\U0001f600", "   "]
    texts = ["", None, " ", "  a  b ", *("".join(random.choices(parts, k=random.randint(1, 25))) for _ in range(1500))]
    for t, (ids, same) in zip(texts, p.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == p.other.encode(t or ""), t
        assert same
        assert "▁" in (t or "") or p.decode(ids) == (t or "")
    d = odd_docs(spark, ["a b", "", None, "a b", "x" * 3000])
    e = pieces.encode(d, tokenizer_file("piece_bpe_32k.model"))
    assert {r.doc_id: r.text for r in pieces.decode(e, tokenizer_file("piece_bpe_32k.model")).collect()} == {0: "a b", 1: "", 2: "", 3: "a b", 4: "x" * 3000, None: "no id at all"}
    assert all(r.parity and r.round_trip for r in pieces.digest(d, tokenizer_file("piece_bpe_32k.model")).collect())
