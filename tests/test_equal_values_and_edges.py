"""Equal values, contig starts, large counts and large tables against exact or plain answers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import tails
from strandloom.operators import matrix as mx
from strandloom.operators import proteins as pr
from strandloom.operators import sequences as sq
from strandloom.operators import variants as va
from strandloom.plans import registry


def test_kinase_scores_of_values_equal_up_to_rounding_are_null(spark):
    rows = [(g, 0, math.nextafter(0.05, g % 3)) for g in range(11)]  # the neighbours of 0.05
    sites = spark.createDataFrame(rows, "gene long, residue long, value double")
    prior = spark.createDataFrame([(g % 2, g, 0) for g in range(11)], "kinase long, gene long, residue long")
    got = pr.kinase_activity(sites, prior).collect()
    assert {r.kinase: (r.m, round(r["mean"], 12), r.z, r.p, r.q) for r in got} == {0: (6, 0.05, None, None, None), 1: (5, 0.05, None, None, None)}
    spread = pr.kinase_activity(spark.createDataFrame([(g, 0, 5.0 + g * 1e-9) for g in range(4)], sites.schema), prior)
    assert {r.kinase: round(r.z, 3) for r in spread.collect()} == {0: -0.548, 1: 0.548}


def test_a_variant_that_reaches_the_start_of_its_contig_ends_with_the_base_after(spark):
    contigs = {"a": "GTGTGTGAC", "b": "A" * 30 + "C"}
    ref = spark.createDataFrame([(n, k // 4, c[k : k + 4]) for n, c in contigs.items() for k in range(0, len(c), 4)], "chrom string, chunk long, seq string")
    rows = [(0, "a", 6, "TG", "TGTG"), (1, "a", 4, "TGT", "T"), (2, "b", 29, "AA", "A"), (3, "b", 20, "A", "AAA"), (4, "a", 1, "GTG", "G"), (5, "a", 1, "AC", "C"), (6, "a", 2, "G", "C"), (7, "a", 7, "GA", "G"), (8, "a", 1, "GT", "G")]
    v = spark.createDataFrame(rows, "id long, chrom string, pos long, ref string, alt string")
    got = {r.id: (r.pos, r.ref, r.alt) for r in va.normalize_variant(v, ref, chunk=4, look=2, anchor_after=True).collect()}
    assert got == {0: (1, "G", "GTG"), 1: (1, "GTG", "G"), 2: (1, "AA", "A"), 3: (1, "A", "AAA"), 4: (1, "GTG", "G"), 5: (1, "AC", "C"), 6: (2, "G", "C"), 7: (7, "GA", "G"), 8: (1, "GT", "G")}


def test_normalize_variant_gives_the_rows_of_its_sql_at_contig_starts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = {0: "A" * 260, 1: "ACG" * 90, 2: "GT" * 130 + "CA" * 40, 3: "ACGT" * 10}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["normalize_variant"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(registry.ORACLES["normalize_variant"]).fetchall())
    assert any(pos == 1 and alt for _, _, pos, _, alt in got)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_least_squares_go_by_sums_and_equal_plain_fits(spark):
    rng, rows = np.random.default_rng(3), []
    for f in range(80):
        for s in range(int(rng.integers(2, 13))):
            c, b = float(s % 2), float(rng.normal() * 1e-3 + 5e4 if f % 2 else s // 3)
            rows.append((f, float(rng.normal() + c), c if f % 10 else 1.0, b if f % 7 else c))
    rows += [(80, 1.0, None, 2.0), (81, None, 1.0, 2.0), *[(82, 3.0, float(s % 2), float(s // 2)) for s in range(6)], *[(83, float(s % 2), float(s % 2), float(s // 2)) for s in range(6)], (0, float("nan"), 1.0, 1.0)]
    d = spark.createDataFrame(rows, "feature long, x double, c double, b double").repartition(5)
    fitted = mx.feature_ols(d, design=["c", "b"], term="c")
    assert "FlatMapGroups" not in plan_of(fitted)
    for r in fitted.collect():
        v = np.array([t[1:] for t in rows if t[0] == r.feature and None not in t and t[1] == t[1]]).reshape(-1, 3)
        x = np.column_stack([np.ones(len(v)), v[:, 1] - v[:1, 1].sum(), v[:, 2] - v[:1, 2].sum()])
        assert r.n == len(v)
        if len(v) <= 3 or np.linalg.matrix_rank(x) < 3:
            assert (r.beta, r.se, r.df, r.t, r.p) == (None,) * 5
            continue
        b = np.linalg.lstsq(x, v[:, 0], rcond=None)[0]
        s2 = ((v[:, 0] - x @ b) ** 2).sum() / (len(v) - 3)
        assert r.beta == pytest.approx(b[1], rel=1e-6, abs=1e-9) and r.s2 == pytest.approx(s2, rel=1e-6, abs=1e-12) and r.df == len(v) - 3
        if s2 > 1e-20:
            assert r.se == pytest.approx(np.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1]), rel=1e-6) and r.p == pytest.approx(tails.t_two_sided(r.t, r.df), abs=1e-12)
        else:
            assert (r.se, r.t, r.p) == (0.0, None, None)


def test_t_tails_of_arrays_equal_single_ones():
    rng = np.random.default_rng(4)
    t, df = rng.normal(0, 4, 3000), rng.choice([1, 2, 3, 9, 50.5, 1e4], 3000)
    assert np.abs(tails.t_two_sided_all(t, df) - [tails.t_two_sided(a, b) for a, b in zip(t.tolist(), df.tolist())]).max() < 1e-10
    odd = tails.t_two_sided_all(np.array([0.0, np.inf, -5.0, np.nan, 2.0]), np.array([5, 4, 0, 5, np.nan]))
    assert odd[:2].tolist() == [1.0, 0.0] and np.isnan(odd[2:]).all()


def test_priors_of_variances_read_one_written_table(spark):
    rng = np.random.default_rng(6)
    rows = [(f, float(rng.normal()), float(s % 2)) for f in range(50) for s in range(4 + f % 4)]
    fitted = mx.feature_ols(spark.createDataFrame(rows, "feature long, x double, c double"), design=["c"], term="c")
    got = mx.moderated_t(fitted)
    assert "FileScan" in plan_of(got) and "covar_pop" not in plan_of(got)
    r = {x.feature: x for x in got.collect()}
    e = [math.log(x.s2) - tails.digamma(x.df / 2) + math.log(x.df / 2) for x in r.values()]
    spread = np.var(e, ddof=1) - np.mean([tails.trigamma(x.df / 2) for x in r.values()])
    d0 = 2 * tails.trigamma_inverse(spread) if spread > 0 else math.inf
    s0 = math.exp(np.mean(e) + (tails.digamma(d0 / 2) - math.log(d0 / 2) if d0 < math.inf else 0))
    assert r[7].s2_post == pytest.approx((d0 * s0 + r[7].df * r[7].s2) / (d0 + r[7].df) if d0 < math.inf else s0)


def test_taxa_are_tested_without_groups_in_python(spark):
    rng = np.random.default_rng(5)
    rows = [(f, s, int(k)) for f in range(30) for s in range(8) if (k := rng.poisson(3 + f % 5))]
    d = spark.createDataFrame(rows, "feature long, sample long, n long")
    s = spark.createDataFrame([(i, float(i % 2), float(i // 4)) for i in range(8)], "sample long, c double, b double")
    got = mx.differential_taxa(d, s, design=["c", "b"], term="c", least=3)
    assert "FlatMapGroups" not in plan_of(got)
    n = np.zeros((30, 8))
    for f, i, k in rows:
        n[f, i] = k
    l = np.log(n[(n > 0).sum(axis=1) >= 3] + 0.5)
    y = l - l.mean(axis=0)
    want = np.linalg.lstsq(np.column_stack([np.ones(8), np.arange(8) % 2, np.arange(8) // 4]), y.T, rcond=None)[0][1]
    assert [r.beta for r in got.orderBy("feature").collect()] == pytest.approx(want.tolist())


def test_drift_is_corrected_by_shared_matrices_and_equals_plain_fits(spark):
    rng, rows = np.random.default_rng(7), []
    for f in range(40):
        for o in sorted(rng.choice(20, 12, replace=False).tolist()) if f % 3 else range(14):
            rows.append((f, o, None if rng.random() < 0.1 else float(50 + 3 * o + rng.normal()), o % 2 == 0 or f % 8 == 0))
    d = spark.createDataFrame(rows, "feature long, order int, value double, is_qc boolean").repartition(6)
    got = mx.drift_correct(d)
    assert "FlatMapGroups" not in plan_of(got) and got.dtypes == [*d.dtypes, ("corrected", "double")]
    got = {(r.feature, r.order): r.corrected for r in got.collect()}
    assert set(got) == {r[:2] for r in rows}
    for f in range(40):
        own = [r for r in rows if r[0] == f]
        x, y = np.array([(r[1], r[2]) for r in own if r[3] and r[2] is not None], float).reshape(-1, 2).T
        for _, o, v, _ in own:
            if v is None:
                assert got[f, o] is None
                continue
            trend = mid = np.median(y) if len(x) else 0
            if len(x) < 4:
                assert got[f, o] == v
                continue
            if x.min() <= o <= x.max():
                dist = np.abs(x - o)
                h = np.sort(dist)[max(3, int(0.75 * len(x))) - 1]
                w = np.sqrt(np.clip(1 - (dist / h) ** 3, 0, None) ** 3)
                m = np.column_stack([np.ones(len(x)), x - o, (x - o) ** 2])
                trend = np.linalg.lstsq(m * w[:, None], y * w, rcond=None)[0][0]
                trend = trend if trend > 0 else mid
            assert got[f, o] == pytest.approx(v / trend * mid, rel=1e-6)



def sets_of(spark, rng, n, odd):
    rows = [(f"k{i}", [f"b{j}" for j in rng.choice(30, int(rng.integers(0, 14)), replace=False)]) for i in range(n)]
    rows += [("z1", [None, "b1", "b2"]), ("z2", [None, "b1", "b1"]), ("z3", []), (None, ["b1", "b2"]), ("z4", None), *([("k0", ["b3", "b4"])] if odd else [])]
    return spark.createDataFrame(rows, "id string, bits array<string>").repartition(3)


def test_pairs_by_blocks_equal_those_by_prefixes(spark):
    rng = np.random.default_rng(8)
    d, e = sets_of(spark, rng, 150, False), sets_of(spark, rng, 60, True)
    for t in (0.2, 0.5, 1.0):
        for run in (lambda **how: sq.similarity_pairs(d, threshold=t, **how), lambda **how: sq.tanimoto_search(e, d, threshold=t, **how)):  # noqa: B023
            one, two = (sorted(tuple(r) for r in run(**how).collect()) for how in ({"by_blocks": False}, {"by_blocks": True, "block": 20}))
            assert one == two and one
    dense = sq.similarity_pairs(d, threshold=0.2)
    assert "MapInArrow" in plan_of(dense) and sorted(tuple(r) for r in dense.collect()) == sorted(tuple(r) for r in sq.similarity_pairs(d, threshold=0.2, by_blocks=False).collect())
    sparse = spark.createDataFrame([(i, [i, i + 1, 1000 + i, 2000 + i]) for i in range(300)], "id long, bits array<long>")
    assert "MapInArrow" not in plan_of(sq.similarity_pairs(sparse, threshold=0.9))
    assert sq.similarity_pairs(d.limit(0), threshold=0.5).count() == 0


def test_a_search_of_few_bits_makes_no_row_for_a_pair_below_the_threshold(spark):
    rng = np.random.default_rng(10)
    x = rng.random((200, 16)) < 0.4
    d = spark.createDataFrame([(i, np.flatnonzero(r).tolist()) for i, r in enumerate(x)], "id long, bits array<int>")
    found = sq.tanimoto_search(d.where("id % 10 = 0"), d, threshold=0.6)
    assert "MapInArrow" in plan_of(found)
    want = {(i, j) for i in range(0, 200, 10) for j in range(200) if (x[i] | x[j]).sum() and (x[i] & x[j]).sum() / (x[i] | x[j]).sum() >= 0.6}
    assert {(r.id_a, r.id_b) for r in found.collect()} == want


def test_clusters_read_written_pairs(spark, tmp_path, monkeypatch):
    from strandloom.plans import sequences as plans

    rng = np.random.default_rng(11)
    spark.createDataFrame([(i, rng.normal(0, 0.125, 64).tolist(), 0) for i in range(40)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, run = [], sq.butina_clusters
    monkeypatch.setattr(plans.sq, "butina_clusters", lambda p, *a, **how: seen.append(plan_of(p)) or run(p, *a, **how))
    assert registry.QUERIES["butina_clusters"](spark, str(tmp_path)).count() == 40
    assert "FileScan" in seen[0] and "Join" not in seen[0] and "MapInArrow" not in seen[0]


def test_neighbours_by_small_blocks_equal_plain_ones(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(90, 5)), np.repeat(rng.normal(size=(2, 5)), 20, axis=0)]).round(3)
    names = [None if i % 11 == 0 else "abc"[i % 3] for i in range(len(x))]
    d = spark.createDataFrame([(i, v.tolist(), n) for i, (v, n) in enumerate(zip(x, names))], "id long, embedding array<double>, label string").repartition(4)
    ref, query = d.where("id % 4 <> 0"), d.where("id % 4 = 0")
    rows = [i for i in range(len(x)) if i % 4]

    def near(i):
        return sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), names[j] is not None, names[j] or "") for j in rows)[:7]

    gate = np.quantile([np.mean([t[0] for t in near(i)]) for i in rows], 0.9)
    for block in (9, 2048):
        for r in sq.knn_label_transfer(ref, query, k=7, gate=0.9, block=block).collect():
            t = near(int(r.id))
            votes = [n if some else None for _, some, n in t]
            best = min((-votes.count(n), n is not None, n or "") for n in set(votes))
            mean = np.mean([u[0] for u in t])
            assert r.distance == pytest.approx(mean) and r.vote_share == pytest.approx(-best[0] / 7)
            assert r.label == ("Unknown" if mean > gate else best[2] if best[1] else None)


def test_a_task_keeps_k_neighbours_over_all_blocks_it_reads():
    import pyarrow as pa

    rng = np.random.default_rng(12)
    q, m = rng.normal(size=(6, 4)), rng.normal(size=(5, 30, 4))
    rows = [(0, [f"q{i}" for i in range(6)], q.ravel().tolist(), y, ["a"] * 30, m[y].ravel().tolist()) for y in range(5)]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=list("xkvylm"))]
    got = [r for b in sq._nearest(batches, 3) for r in b.to_pylist()]
    want = np.sort(np.linalg.norm(q[:, None] - m.reshape(-1, 4)[None], axis=2), axis=1)[:, :3]
    assert len(got) == 18 and np.allclose([r["d"] for r in got], want.ravel())


def test_rarefaction_of_large_samples_equals_exact_products(spark):
    cases = [(1, 0), (5, 3), (50_000_000, 60), (50_000_000, 1), (40, 12), (1_000, 990), (7, 7)]  # the feature's own count is the second, others make up the total
    rows = [r for k, (total, n) in enumerate(cases) for r in ([(k, n)] if n else []) + ([(k, total - n)] if total > n else [])]
    depths = [1, 5, 10, 1_000, 100_000]
    got = {(r.sample, r.depth): r.expected for r in mx.rarefaction_curve(spark.createDataFrame(rows, "sample int, n long"), depths).collect()}

    def seen(total, n, d):
        if total - n < d:
            return 1.0
        k, m = min(n, d), max(n, d)
        return -math.expm1(math.fsum(math.log1p(-m / (total - i)) if m < total - i else -math.inf for i in range(k)))

    for k, (total, n) in enumerate(cases):
        for d in depths:
            assert ((k, d) in got) == (d <= total)
            if d <= total:
                assert got[k, d] == pytest.approx(sum(seen(total, x, d) for x in (n, total - n) if x), rel=1e-9)
    many = spark.range(200_000).select(F.lit(0).alias("sample"), F.lit(250).cast("long").alias("n"))
    assert mx.rarefaction_curve(many, [1000]).first().expected == pytest.approx(200_000 * seen(50_000_000, 250, 1000), abs=1e-5)


def test_blocks_of_a_large_family_meet_once_without_copies_in_a_shuffle(spark):
    from strandloom.llm import shingle_join as sj

    b = lambda rows: spark.createDataFrame([(f, x, [x], [b"12345678"]) for f, x in rows], "family long, x long, ids array<long>, tokens array<binary>")
    rests, tops = b([(1, 0), (1, 1), (1, 2), (2, 0)]), b([(1, -1), (1, -2), (3, -1)])
    met = sj._met(rests, rests.unionByName(tops))
    assert "CartesianProduct" in plan_of(met)
    got = sorted((r.x, r.y) for r in met.collect())
    assert got == sorted([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2), *[(x, y) for x in (0, 1, 2) for y in (-1, -2)], (0, 0)])
