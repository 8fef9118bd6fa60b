"""Registered queries read every row and character of their tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandloom.operators import proteins
from strandloom.operators.components import components
from strandloom.plans import registry


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_aligned_rows_are_whole_texts(spark, tmp_path):
    texts = {1: "Abc, dé\U0001f600 ef\n" * 17, 2: "x" * 60, 3: "", 4: "Hello world", 6: "abcdefghij" * 18 + "z"}
    sf = put(spark, tmp_path, "documents", [(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = {}
    for i, t in texts.items():
        s = re.sub("[^A-Za-z]", "-", t).upper()
        for k in range(max(1, -(-len(s) // 60))):
            want[f"{k}:{i}"] = s[60 * k : 60 * k + 60].ljust(60, "-")
    run = lambda name: registry.QUERIES[name](spark, sf).collect()
    at = defaultdict(Counter)
    for s in want.values():
        for c, x in enumerate(s):
            at[c][x] += 1
    assert {r.col: r.gaps for r in run("gap_statistics")} == {c: k["-"] for c, k in at.items()}
    assert {r.id: r.residues for r in run("position_map")} == {i: 60 - s.count("-") for i, s in want.items()}
    first: dict = {}
    for i, s in sorted(want.items()):
        if int(i[-1]) % 2 == 0 and s.count("-") / 60 <= 0.3:
            first.setdefault(s, i)
    assert sorted(r.id for r in run("filter_sequences")) == sorted(first.values())
    kept = [c for c in range(60) if at[c]["-"] / len(want) < 0.2]
    assert {r.id: r.seq for r in run("mask_columns")} == {i: "".join(s[c] for c in kept) for i, s in want.items()}
    pairs = Counter()
    for k in at.values():
        for a in k:
            for b in k:
                if "-" < a < b:
                    pairs[a, b] += k[a] * k[b]
    assert {(r.first, r.second): r.n for r in run("substitution_counts")} == pairs
    best = {c: min((-n, min(i for i, s in want.items() if s[c] == x), x) for x, n in k.items() if x != "-") for c, k in at.items()}
    assert {r.col: (r.residue, r.share) for r in run("consensus_sequence")} == {c: (x, round(-n / len(want), 6)) for c, (n, _, x) in best.items()}
    for name in ("conservation_profile", "information_content", "jsd_conservation"):
        assert len(run(name)) == 60
    assert len(run("pssm")) == 60 * 26


LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """The folder of a table of 2,000 lines, and its rows."""
    rng = random.Random(5)
    rows = [(k // 4, rng.randrange(1, 420), rng.randrange(1, 25), k % 4 + 1, float(rng.randrange(1, 51)), round(rng.uniform(900, 90000), 2), rng.randrange(11) / 100, 0.02, "N", "O") for k in range(2000)]
    return put(spark, tmp_path_factory.mktemp("lines"), "lineitem", rows, LINE), rows


def test_holm_over_all_values(spark, tmp_path):
    sf = put(spark, tmp_path, "events", [(k, k % 9, "view", 1.0) for k in range(400)], "event_id long, user_id long, event_type string, value double")
    p = {k: (k * 7919 % 10007 + 1) / 10008 for k in range(400) if k % 17}
    want, most = {}, 0.0
    for r, (x, k) in enumerate(sorted((x, k) for k, x in p.items())):  # no ties
        want[k] = most = max(most, min(1.0, (len(p) - r) * x))
    got = {r.psm: r.q for r in registry.QUERIES["adjust_p_holm"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_proteins_of_all_lines(spark, lines):
    sf, rows = lines
    for name, mod in (("collapse_proteins", 40), ("parsimony_groups", 300)):
        sets = defaultdict(set)
        for r in rows:
            sets[("DECOY_" if r[2] % 4 == 3 else "") + f"S{r[2]}"].add(r[0] % mod)
        groups = defaultdict(list)
        for k, s in sets.items():
            groups[frozenset(s)].append(k)
        got = registry.QUERIES[name](spark, sf).collect()
        if name == "collapse_proteins":
            assert {r.name: (r.n_members, r.n_peptides) for r in got} == {min(m): (len(m), len(s)) for s, m in groups.items()}
            continue
        left, covered, want = {min(m): s for s, m in groups.items()}, set(), {}
        while left:
            new, _, k = min((-len(s - covered), -len(s), k) for k, s in left.items())
            want[k] = -new
            covered |= left.pop(k)
        assert {r.name: r.new_peptides for r in got} == want


def test_drift_of_all_features(spark, lines):
    sf, rows = lines
    got = {(r.feature, r.sample) for r in registry.QUERIES["drift_correct"](spark, sf).collect()}
    assert got == {(r[1], r[2] % 12) for r in rows}


def test_calibration_and_quantities_of_all_lines(spark, lines):
    sf, rows = lines
    got = defaultdict(list)
    for r in registry.QUERIES["weighted_calibration"](spark, sf).collect():
        got[r.analyte].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for a, out in got.items():
        s = [(f"{r[0]}:{r[3]}", r[4], r[5] / 1000) for r in rows if r[1] % 20 == a]
        x, y = np.array([r[1] for r in s]), np.array([r[2] for r in s])
        slope, intercept = np.polyfit(x, y, 1, w=1 / x)
        error = abs((y - intercept) / slope / x - 1)
        ok = x[error <= np.where(x == x.min(), 0.2, 0.15)]
        lloq = ok.min() if len(ok) else None
        assert (out[0].slope, out[0].intercept) == pytest.approx((slope, intercept), abs=1e-4) and {r.lloq for r in out} == {lloq}
        want = {k: c if lloq is not None and c >= lloq else None for k, c in ((k, (b - intercept) / slope) for k, _, b in s)}
        assert {r.sample: r.concentration for r in out} == pytest.approx(want, abs=1e-4)


def test_precision_of_all_lines(spark, lines):
    sf, rows = lines
    bins = defaultdict(list)
    for r in rows:
        bins[r[3] % 4, r[1] % 5, r[0] % 20].append(r[4])
    for r in registry.QUERIES["precision_components"](spark, sf).collect():
        level = 0 if r.level == "LLOQ" else int(r.level[1:])
        days = [[np.mean(bins[level, d, k]) for k in range(20)] for d in range(5)]
        worst = max(np.std(d, ddof=1) / np.mean(d) for d in days)
        within, between = np.mean([np.var(d, ddof=1) for d in days]), np.var([np.mean(d) for d in days], ddof=1)
        both = within + max(0, between - within / 20)
        assert (r.mean, r.intra_cv, r.inter_cv) == pytest.approx([np.mean(days), worst, both**0.5 / np.mean(days)], abs=1e-6)


def test_events_of_all_lines(spark, lines):
    sf, rows = lines
    psi = defaultdict(list)
    for r in rows:
        psi[r[2], r[1] % 20].append(10 * r[6])
    m = {k: sum(x) / len(x) for k, x in psi.items()}
    of = defaultdict(list)
    for (e, _), x in m.items():
        of[e].append(x)
    want = {k: x for k, x in m.items() if len(of[k[0]]) >= 10 and 0.05 < sum(of[k[0]]) / len(of[k[0]]) < 0.52}
    assert want and {(r.event, r.sample): r.psi for r in registry.QUERIES["filter_events"](spark, sf).collect()} == pytest.approx(want, abs=1e-6)


def test_gene_sets_stay_small_in_large_tables(spark, tmp_path):
    rng = random.Random(6)
    parts = [(10 * k, "n", "A" if k % 2 else "B", "t", 1, 1.0) for k in range(1200)]  # 600 a brand
    put(spark, tmp_path, "part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    d = {p[0]: rng.randrange(11) / 100 for p in parts}
    sf = put(spark, tmp_path, "lineitem", [(k, k, 1, 1, 1.0, 1.0, x, 0.0, "N", "O") for k, x in d.items()], LINE)
    sets = defaultdict(list)
    for p in parts:
        sets[p[2] + (f"/{p[0] // 2000}" if p[0] >= 2000 else "")].append(p[0])
    assert {len(s) for s in sets.values()} == {100} and len(sets) == 12
    hits, total = {k for k, x in d.items() if x > 0.052}, len(d)
    tail = lambda k: sum(math.comb(len(hits), i) * math.comb(total - len(hits), 100 - i) for i in range(k, 101)) / math.comb(total, 100)
    want = {s: (len(hits & set(g)), pytest.approx(tail(len(hits & set(g))), abs=2e-6)) for s, g in sets.items()}
    assert {r.set: (r.k, r.p) for r in registry.QUERIES["hypergeom_enrichment"](spark, sf).collect()} == want
    ranking = sorted(d, key=lambda k: (-round(d[k] - 0.05, 9), k))
    got = {r.set: r.es for r in registry.QUERIES["gsea_running_sum"](spark, sf).collect()}
    assert set(got) == set(sets)
    for s, g in sets.items():
        w = {k: abs(d[k] - 0.05) for k in g}
        at = np.cumsum([0] + [w[k] / sum(w.values()) if k in w else -1 / (total - 100) for k in ranking])
        assert got[s] == pytest.approx(max(at) if max(at) >= -min(at) else min(at), abs=1e-5)


def test_long_chains_are_one_component(spark, tmp_path):
    n = 200
    nodes = spark.createDataFrame([(f"P{k:03d}", [k, k + 1]) for k in range(n)], "name string, peptides array<long>")
    got = proteins.protein_components(nodes).collect()
    assert len(got) == n and {r.component for r in got} == {"P000"}
    order = list(range(n))
    random.Random(7).shuffle(order)
    pairs = spark.createDataFrame(list(zip(order, order[1:])), "id_a long, id_b long")
    ids = spark.range(n + 1)
    for most in (1, 30, 1_000_000):  # many rounds, some, one task
        got = {r.id: r.component for r in components(pairs, ids, edges_per_task=most).collect()}
        assert got == {k: 0 for k in range(n)} | {n: n}
    with pytest.raises(RuntimeError):
        components(pairs, ids, most_rounds=1, edges_per_task=1)
    sf = put(spark, tmp_path, "embeddings", [(k, [float(k <= i < k + 10) for i in range(n + 10)], "x") for k in range(n)], "vec_id long, embedding array<double>, label string")
    near = {k: {j for j in range(n) if j != k and abs(j - k) <= 4} for k in range(n)}  # (10 - 4) / (10 + 4) >= 0.35
    free, want = set(near), {}
    for k in sorted(near, key=lambda k: (-len(near[k]), k)):
        if k in free:
            members = ({k} | near[k]) & free
            want |= dict.fromkeys(members, k)
            free -= members
    assert {r.id: r.cluster for r in registry.QUERIES["butina_clusters"](spark, sf).collect()} == want
