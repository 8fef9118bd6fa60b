"""Set enrichment with a permutation null against plain loops."""

from __future__ import annotations

import hashlib

import pytest

from strandloom.operators import enrichment


def plain_es(members, ranking):
    """ranking: (gene, score) from the top."""
    hit = sum(abs(s) for g, s in ranking if g in members)
    high = low = at = 0.0
    for g, s in ranking:
        at += (abs(s) / hit if hit else 1 / len(members)) if g in members else -1 / (len(ranking) - len(members))
        high, low = max(high, at), min(low, at)
    return high if abs(high) >= abs(low) else low


def test_gsea_on_forty_genes(spark):
    scores = {f"g{k:02d}": round(((k * 37) % 41 - 20) / 7, 6) for k in range(40)}
    scores["g07"] = 0.0
    ranking = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    top = [g for g, _ in ranking]
    sets = {"up": top[:4] + [top[20]], "down": top[-6:], "mixed": top[::7], "zero": ["g07"], "outside": ["none"], "also up": [top[0], top[3], top[9], top[11], top[12]]}
    r = spark.createDataFrame([*scores.items(), ("g01", -99.0), ("unscored", None)], "gene string, score double")
    s = spark.createDataFrame([(k, g) for k, v in sets.items() for g in v] + [("up", top[0]), ("up", "not ranked")], "set string, gene string")
    got = {x["set"]: x for x in enrichment.gsea(r, s, least=1, most=10, draws=50, seed=4).collect()}
    assert set(got) == set(sets) - {"outside"}
    draws = [sorted(scores, key=lambda g: hashlib.md5(f"4:{b}:{g}".encode()).hexdigest()) for b in range(50)]
    p = {}
    for name, x in got.items():
        es, k = plain_es(set(sets[name]), ranking), len(sets[name])
        null = [plain_es(set(d[:k]), ranking) for d in draws]
        up, down = [v for v in null if v >= 0], [v for v in null if v <= 0]
        assert x.es == pytest.approx(es) and x.size == k
        side = up if es > 0 else down
        assert x.nes == pytest.approx(es / abs(sum(side) / len(side)))
        p[name] = min((1 + sum(v >= es - 1e-12 for v in up)) / (1 + len(up)), (1 + sum(v <= es + 1e-12 for v in down)) / (1 + len(down)))
        assert x.p == pytest.approx(p[name])
    q, least = {}, 1.0
    for i, (name, v) in enumerate(sorted(p.items(), key=lambda x: -x[1])):
        least = min(least, v * len(p) / sum(w <= v for w in p.values()))
        q[name] = least
    assert {n: x.q for n, x in got.items()} == pytest.approx(q)
    assert got["up"].leading_edge == 4 and got["up"].nes > 1 > got["mixed"].nes


def test_draws_leave_out_genes_that_no_set_can_reach(spark):
    r = spark.range(1, 5001).selectExpr("cast(id as string) gene", "id r", "1.0 / id w")
    null = enrichment.null_scores(r, [3, 15], 5000, draws=7, seed=1)
    assert null.count() == 14
    order = sorted(range(1, 5001), key=lambda g: hashlib.md5(f"1:2:{g}".encode()).hexdigest())
    want = plain_es({str(g) for g in order[:15]}, [(str(g), 1.0 / g) for g in range(1, 5001)])
    assert null.where("draw = 2 and size = 15").first().null_es == pytest.approx(want)


def test_no_sets(spark):
    r = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "gene string, score double")
    assert enrichment.gsea(r, spark.createDataFrame([], "set string, gene string"), draws=5).count() == 0
