"""Interval joins over bins of several levels against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandloom.operators import intervals

SCHEMA = "id long, contig string, start long, stop long"


def rows(seed, n, contigs=("c1", "c2")):
    random.seed(seed)
    out = []
    for k in range(n):
        size = random.choice([1, 2, 50, 900, 1024, 1025, 8192, 8193, 70_000, 1_000_000, 200_000_000])
        at = random.choice([random.randint(0, 4000), random.randint(0, 250_000_000), 1024 * random.randint(0, 9)])
        out.append((k, random.choice(contigs), at, at + size))
    return out


def overlaps(a, b):
    return sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])


def test_pairs_of_all_lengths_come_once(spark):
    a, b = rows(1, 300), rows(2, 250, ("c2", "c3", "c1")) + [(900, "c1", 5, 5), (901, None, 0, 10), (902, "c2", None, 4)]
    x, y = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    assert sorted((r.a_id, r.b_id) for r in intervals.interval_join(x, y).collect()) == overlaps(a, b[:-3])
    assert sorted((r.a_id, r.b_id) for r in intervals.interval_join(y, x, width=100).collect()) == sorted((j, i) for i, j in overlaps(a, b[:-3]))
    short = [r for r in b[:-3] if r[3] - r[2] < 100]
    assert sorted((r.a_id, r.b_id) for r in intervals.interval_join(x, spark.createDataFrame(short, SCHEMA)).collect()) == overlaps(a, short)


def test_a_long_interval_makes_two_rows_a_level_at_most(spark):
    a, b = rows(3, 200), rows(4, 200) + [(999, "c1", 0, 200_000_000)]
    x, y = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    for left, right in ((x, y), (y, x)):
        for d in intervals._meet(left, right, ("start", "stop"), ("start", "stop"), 1024):
            kind, level = ("_kind", "_level") if "_kind" in d.columns else ("__kind", "__level")
            assert d.groupBy("id", kind, level).count().agg(F.max("count")).first()[0] <= 2
            assert d.where("stop - start >= 200000000").groupBy("id").count().agg(F.max("count")).first()[0] <= 2 * 2 * intervals.LEVELS


def test_semi_and_anti(spark):
    a, b = rows(5, 200), rows(6, 12)
    x, y = spark.createDataFrame(a + a[:3], SCHEMA), spark.createDataFrame(b, SCHEMA)
    hit = {i for i, _ in overlaps(a, b)}
    assert sorted(r.id for r in intervals.interval_semi(x, y).collect()) == sorted(r[0] for r in a + a[:3] if r[0] in hit)
    assert sorted(r.id for r in intervals.interval_anti(x, y).collect()) == sorted(r[0] for r in a + a[:3] if r[0] not in hit)
    assert intervals.interval_anti(x, y.limit(0)).count() == 203 and intervals.interval_semi(x, y.limit(0)).count() == 0


def test_points_in_long_segments(spark):
    segments = spark.createDataFrame([("c1", 0, 200_000_000, 2.0), ("c1", 100, 300, 5.0), ("c1", 200_000_000, 200_000_001, 7.0)], "contig string, start long, stop long, copy_number double")
    points = spark.createDataFrame([("c1", 150), ("c1", 200_000_000), ("c1", 200_000_001), ("c1", 200_000_002), ("c2", 5)], "contig string, at long")
    assert sorted((r.at, r.copy_number) for r in intervals.point_in_segment(points, segments).collect()) == [(5, None), (150, 2.0), (200_000_000, 2.0), (200_000_001, 7.0), (200_000_002, None)]


def test_ends_in_footprints(spark):
    reads = spark.createDataFrame([("c1", 10, 60, False), ("c1", 10, 60, True), ("c1", 500_000, 500_050, False)], "contig string, start long, stop long, reverse boolean")
    sites = spark.createDataFrame([("c1", 0, 1_000_000, "+"), ("c1", 50, 70, "-"), ("c1", 5, 20, "+")], "contig string, start long, stop long, strand string")
    r = intervals.end_in_footprint(reads, sites).first()
    assert (r.reads, r.five_prime, r.three_prime) == (3, 3, 2)
