"""Left alignment against a plain version, over repeats that span many stretches."""

from __future__ import annotations

import random

import pytest

from strandloom.operators import variants

SCHEMA = "id long, chrom string, pos long, ref string, alt string"


def plain(pos, ref, alt, contig):
    while ref != alt:
        if ref and alt and ref[-1] == alt[-1] and len(ref) + len(alt) > 2:
            ref, alt = ref[:-1], alt[:-1]
        elif ref and alt or pos == 1:
            break
        if not ref or not alt:
            if pos == 1:
                break
            pos -= 1
            ref, alt = contig[pos - 1] + ref, contig[pos - 1] + alt
    while ref != alt and min(len(ref), len(alt)) > 1 and ref[0] == alt[0]:
        ref, alt, pos = ref[1:], alt[1:], pos + 1
    return pos, ref, alt


def stretches(spark, contigs, chunk):
    return spark.createDataFrame([(n, k // chunk, c[k : k + chunk]) for n, c in contigs.items() for k in range(0, len(c), chunk)], "chrom string, chunk long, seq string")


def test_known_answers(spark):
    ref = "GGGCACACACTTTAG"
    v = spark.createDataFrame([(0, "c", 8, "CAC", "C"), (1, "c", 12, "T", "TT"), (2, "c", 5, "ACA", "AGA"), (3, "c", 4, "C", "T"), (4, "c", 4, None, "T"), (5, "c", 3, "GC", "GC")], SCHEMA)
    got = {r.id: (r.pos, r.ref, r.alt) for r in variants.normalize_variant(v, stretches(spark, {"c": ref}, 5), chunk=5).collect()}
    assert got == {0: (3, "GCA", "G"), 1: (10, "C", "CT"), 2: (6, "C", "G"), 3: (4, "C", "T"), 4: (4, None, "T"), 5: (3, "GC", "GC")}


@pytest.mark.parametrize("chunk,look", [(7, 2), (10, 64), (50, 3)])
def test_equals_the_plain_version(spark, chunk, look):
    random.seed(chunk)
    contigs = {"a": "T" + "CA" * 30 + "G" + "A" * 40, "b": "".join(random.choice("AC") for _ in range(90)), "c": "AT" * 40}
    rows = []
    for k in range(150):
        n = random.choice(list(contigs))
        c = contigs[n]
        p, size = random.randint(1, len(c) - 6), random.randint(1, 5)
        ref = c[p - 1 : p - 1 + size]
        alt = random.choice([ref[:1], ref + random.choice([ref, "A", "CA", c[p - 1 + size : p + 1 + size]]), "".join(random.choice("ACGT") for _ in range(size)), ref])
        if alt == ref[:1] and size == 1:
            alt = ref + ref
        rows.append((k, n, p, ref, alt))
    got = {r.id: (r.pos, r.ref, r.alt) for r in variants.normalize_variant(spark.createDataFrame(rows, SCHEMA), stretches(spark, contigs, chunk), chunk=chunk, look=look).collect()}
    assert got == {k: plain(p, r, a, contigs[n]) for k, n, p, r, a in rows}


def test_a_repeat_over_many_stretches_and_missing_ones(spark):
    contig = "GG" + "CA" * 60
    v = spark.createDataFrame([(0, "c", 101, "CAC", "C")], SCHEMA)
    r = stretches(spark, {"c": contig}, 10)
    got = variants.normalize_variant(v, r, chunk=10).first()
    assert contig[100:103] == "CAC" and (got.pos, got.ref, got.alt) == (2, "GCA", "G")
    with pytest.raises(ValueError):
        variants.normalize_variant(v, r.where("chunk <> 4"), chunk=10)
    assert variants.normalize_variant(v.limit(0), r, chunk=10).count() == 0
