"""Interval tables: joins, coverage of one table by another, merging, flanks, fixed-width consensus.

Half-open coordinates. Overlap joins put both sides into bins of a contig.
Bins have levels, each eight times as wide as the one below; an interval is at
home in the level whose bins are just as long as it or longer, so that it lies
in two bins at most. An interval also stands in the bins of the higher levels
where the other side has intervals at home, again in two at most. Two
intervals therefore meet at the home level of the longer one, however long it
is, and a pair is emitted from the bin that holds the greater start, so it
comes once. Which levels a side uses is one small aggregate of its own columns
(a scalar subquery), so short intervals aren't
repeated for levels that nobody uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.scratch import Scratch

#: Bins of a level are so many times as wide as those below; levels reach from ``width`` to ``width * STEP ** (LEVELS - 1)`` bases.
STEP, LEVELS = 8, 13
_PLACE = ["_kind", "_level", "_bin"]


def _home(start: Column, stop: Column, width: int) -> Column:
    """The lowest level whose bins are as long as the interval."""
    length = stop - start
    return sum(((length > F.lit(width * STEP**k)).cast("int") for k in range(LEVELS - 1)), F.lit(0))


def _width(width: int, level: Column) -> Column:
    return F.get(F.array(*[F.lit(width * STEP**k) for k in range(LEVELS)]), level)


def _levels(df: DataFrame, start: Column, stop: Column, width: int, *, second: bool) -> DataFrame:
    """One row: for each home level of the one side, the kinds and levels at which it meets the other side, which is ``df``.

    Kind 0 are meetings at the home level of the second side, kind 1 those at a
    higher home level of the first; a side has home rows of a kind only where
    the other has intervals as short as that.
    """
    at = lambda kind, level: F.struct(F.lit(kind).alias("_kind"), level.alias("_level"))

    def met(home: Column) -> Column:
        up = F.transform(F.filter("_l", lambda x: x > home if second else x >= home), lambda x: at(int(second), x))
        below = F.exists("_l", lambda x: x <= home if second else x < home)
        return F.concat(up, F.when(below, F.array(at(int(not second), home))).otherwise(F.slice(up, 1, 0)))

    mask = df.agg(F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1), _home(start, stop, width))), F.lit(0)).alias("_m"))
    held = mask.select(F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda x: F.call_function("shiftright", F.col("_m"), x).bitwiseAND(1) == 1).alias("_l"))
    return held.select(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), met).alias("_plan"))


def _placed(df: DataFrame, start: Column, stop: Column, width: int, plan: DataFrame) -> DataFrame:
    """A row for each bin in which an interval can meet one of the other side. A row that can meet nothing stays once, with nulls."""
    own = [F.col(f"`{c}`") for c in df.columns]
    d = df.select(*own, F.get(plan.scalar(), _home(start, stop, width)).alias("_plan"))
    d = d.select(*own, F.explode_outer("_plan").alias("_place")).select(*own, "_place.*")
    w = _width(width, F.col("_level"))
    first, last = F.floor(start / w).cast("long"), F.floor((F.greatest(stop, start + 1) - 1) / w).cast("long")
    return d.select(*own, "_kind", "_level", F.explode_outer(F.sequence(first, last)).alias("_bin"))


def _meet(left: DataFrame, right: DataFrame, ends: tuple[str, str], others: tuple[str, str], width: int) -> tuple[DataFrame, DataFrame]:
    """Both tables by the bins where they meet; the columns of the second one's bins begin with ``__``."""
    (s, e), (t, f) = (tuple(map(F.col, x)) for x in (ends, others))
    a = _placed(left, s, e, width, _levels(right, t, f, width, second=False))
    b = _placed(right, t, f, width, _levels(left, s, e, width, second=True))
    return a, b.withColumnsRenamed({c: f"_{c}" for c in _PLACE})


_SAME = " and ".join(f"{c} = _{c}" for c in _PLACE)


def interval_join(a: DataFrame, b: DataFrame, *, contig: str = "contig", start: str = "start", stop: str = "stop", width: int = 1024, prefixes: tuple[str, str] = ("a", "b"), condition: Column | None = None) -> DataFrame:
    """All overlapping pairs; columns of both sides with prefixes (``a_start``, ``b_start``, ...). ``width`` is the bin width of the lowest level."""
    x, y = prefixes
    left = a.select(*[F.col(c).alias(f"{x}_{c}") for c in a.columns]).where(F.col(f"{x}_{start}") < F.col(f"{x}_{stop}"))
    right = b.select(*[F.col(c).alias(f"{y}_{c}") for c in b.columns]).where(F.col(f"{y}_{start}") < F.col(f"{y}_{stop}"))
    left, right = _meet(left, right, (f"{x}_{start}", f"{x}_{stop}"), (f"{y}_{start}", f"{y}_{stop}"), width)
    greater = F.greatest(f"{x}_{start}", f"{y}_{start}")
    on = (F.col(f"{x}_{contig}") == F.col(f"{y}_{contig}")) & F.expr(_SAME) & (F.col(f"{x}_{start}") < F.col(f"{y}_{stop}")) & (F.col(f"{y}_{start}") < F.col(f"{x}_{stop}"))
    first = F.floor(greater / _width(width, F.col("_level"))).cast("long")
    out = left.join(right, on & (F.col("_bin") == first))
    if condition is not None:
        out = out.where(condition)
    return out.drop(*_PLACE, *[f"_{c}" for c in _PLACE])


def merge_intervals(df: DataFrame, *, contig: str = "contig", start: str = "start", stop: str = "stop", tile: int = 1 << 20) -> DataFrame:
    """Touching or overlapping intervals of a contig as one: contig, start, stop, n.

    Runs are merged within tiles of a contig first, so the window over a whole
    contig sees only the merged runs, not every interval.
    """

    def merged(d: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(start, stop)
        before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return d.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.sum("_k").alias("_k")).drop("_g")

    d = df.where(F.col(start) < F.col(stop)).select(contig, start, stop, F.lit(1).alias("_k"), F.floor(F.col(start) / tile).alias("_tile"))
    out = merged(merged(d, [contig, "_tile"]).drop("_tile"), [contig])
    return out.select(contig, start, stop, F.col("_k").alias("n"))


def interval_semi(a: DataFrame, regions: DataFrame, *, contig: str = "contig", start: str = "start", stop: str = "stop", width: int = 1024, anti: bool = False) -> DataFrame:
    """Rows of ``a`` that overlap a region, each once (``anti``: those that overlap none). Rows of ``a`` need not be unique."""
    r = merge_intervals(regions, contig=contig, start=start, stop=stop).select(F.col(contig).alias("_c"), F.col(start).alias("_s"), F.col(stop).alias("_e")).withColumn("_hit", F.lit(1))
    x, r = _meet(a.withColumn("_id", F.monotonically_increasing_id()), r, (start, stop), ("_s", "_e"), width)
    on = (F.col(contig) == F.col("_c")) & F.expr(_SAME) & (F.col(start) < F.col("_e")) & (F.col("_s") < F.col(stop))
    if not anti:
        return x.join(r, on, "left_semi").dropDuplicates(["_id"]).select(*a.columns)
    row = F.any_value(F.struct(*[F.col(f"`{c}`") for c in a.columns])).alias("_row")
    return x.join(r, on, "left").groupBy("_id").agg(F.max("_hit").alias("_hit"), row).where("_hit is null").select("_row.*")


def interval_anti(a: DataFrame, regions: DataFrame, **how) -> DataFrame:
    return interval_semi(a, regions, anti=True, **how)


def point_in_segment(points: DataFrame, segments: DataFrame, *, contig: str = "contig", at: str = "at", start: str = "start", stop: str = "stop", value: str = "copy_number", width: int = 1024) -> DataFrame:
    """Left join of points to the segment that holds them, both its ends included; of several, the one that starts first (then the least value). Repeated points stay as they are."""
    s = segments.select(F.col(contig).alias("_c"), F.col(start).alias("_s"), F.col(stop).alias("_e"), F.col(value).alias("_v"), (F.col(stop) + 1).alias("_z"))
    p = points.select(F.col(contig).alias("_pc"), F.col(at).alias("_pa"), (F.col(at) + 1).alias("_pz")).distinct()
    p, s = _meet(p, s, ("_pa", "_pz"), ("_s", "_z"), width)
    on = (F.col("_pc") == F.col("_c")) & F.expr(_SAME) & (F.col("_pa") >= F.col("_s")) & (F.col("_pa") <= F.col("_e"))
    found = p.join(s, on).groupBy("_pc", "_pa").agg(F.min(F.struct("_s", "_v")).alias("_m"))
    j = points.join(found, (F.col(contig) == F.col("_pc")) & (F.col(at) == F.col("_pa")), "left")
    return j.select(*[F.col(f"`{c}`") for c in points.columns], F.col("_m._v").alias(value))


def flank_join(sites: DataFrame, genes: DataFrame, *, flank: int, contig: str = "contig", at: str = "pos", start: str = "start", stop: str = "stop", width: int = 1024) -> DataFrame:
    """Sites strictly within ``flank`` of a gene: columns of both (``s_``, ``g_``)."""
    s = sites.withColumn(start, F.col(at)).withColumn(stop, F.col(at) + 1)
    g = genes.withColumn(start, F.col(start) - flank + 1).withColumn(stop, F.col(stop) + flank)
    out = interval_join(s, g, contig=contig, start=start, stop=stop, width=width, prefixes=("s", "g"))
    return out.withColumn(f"g_{start}", F.col(f"g_{start}") + flank - 1).withColumn(f"g_{stop}", F.col(f"g_{stop}") - flank).drop(f"s_{start}", f"s_{stop}")


def paired_anchor_support(links: DataFrame, loops: DataFrame, *, width: int = 1024) -> DataFrame:
    """Links (link, contig, e_start, e_stop, t_start, t_stop) with a loop (loop, contig, a_start, a_stop, b_start, b_stop) whose anchors touch element and target, either way round."""

    def touching(side: str, anchor: str) -> DataFrame:
        x = links.select("link", "contig", F.col(f"{side}_start").alias("start"), F.col(f"{side}_stop").alias("stop"))
        y = loops.select("loop", "contig", F.col(f"{anchor}_start").alias("start"), F.col(f"{anchor}_stop").alias("stop"))
        return interval_join(x, y, width=width).select(F.col("a_link").alias("link"), F.col("b_loop").alias("loop"))

    one = touching("e", "a").join(touching("t", "b"), ["link", "loop"], "left_semi")
    two = touching("e", "b").join(touching("t", "a"), ["link", "loop"], "left_semi")
    return links.join(one.unionByName(two).select("link").distinct().withColumn("supported", F.lit(True)), "link", "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def tss_window(df: DataFrame, *, tss: str = "tss", strand: str = "strand", upstream: int = 1000, downstream: int = 500) -> DataFrame:
    """Adds the strand-aware window around a start site, not below 0."""
    plus = F.col(strand) == "+"
    a = F.when(plus, F.col(tss) - upstream).otherwise(F.col(tss) - downstream)
    b = F.when(plus, F.col(tss) + downstream).otherwise(F.col(tss) + upstream)
    return df.withColumn("window_start", F.greatest(F.lit(0), a)).withColumn("window_stop", b)


def end_in_footprint(reads: DataFrame, sites: DataFrame, *, width: int = 1024) -> DataFrame:
    """Per contig: reads whose 5' end lies in a same-strand site and whose 3' end lies in an opposite-strand one. ``reverse`` and ``strand`` give the strands."""
    five = F.when(F.col("reverse"), F.col("stop") - 1).otherwise(F.col("start"))
    three = F.when(F.col("reverse"), F.col("start")).otherwise(F.col("stop") - 1)
    own = F.when(F.col("reverse"), "-").otherwise("+")
    s = sites.select(F.col("contig").alias("_c"), F.col("start").alias("_s"), F.col("stop").alias("_e"), F.col("strand").alias("_t"))

    def hits(end: Column, same: bool) -> DataFrame:
        d = reads.select("contig", end.alias("_p"), (end + 1).alias("_q"), own.alias("_o")).withColumn("_id", F.monotonically_increasing_id())
        d, t = _meet(d, s, ("_p", "_q"), ("_s", "_e"), width)
        strand = F.col("_t") == F.col("_o") if same else F.col("_t") != F.col("_o")
        on = (F.col("contig") == F.col("_c")) & F.expr(_SAME) & (F.col("_p") >= F.col("_s")) & (F.col("_p") < F.col("_e")) & strand
        return d.join(t, on, "left_semi").select("contig", "_id").distinct().groupBy("contig").agg(F.count(F.lit(1)).alias("five_prime" if same else "three_prime"))

    total = reads.groupBy("contig").agg(F.count(F.lit(1)).alias("reads"))
    return total.join(hits(five, True), "contig", "left").join(hits(three, False), "contig", "left").fillna(0, ["five_prime", "three_prime"])


def variant_near_outlier(variants: DataFrame, outliers: DataFrame, *, distance: int = 1000, width: int = 1024) -> DataFrame:
    """Variants (chrom, pos, sample) within ``distance`` of either end of an outlier event (contig, start, stop, sample) of the same sample; a ``chr`` prefix is ignored."""
    bare = lambda c: F.regexp_replace(c, "^chr", "")
    v = variants.withColumn("contig", bare("chrom")).withColumn("start", F.col("pos")).withColumn("stop", F.col("pos") + 1)
    o = outliers.withColumn("contig", bare("contig")).withColumn("_end", F.explode(F.array("start", "stop")))
    ends = o.select("contig", "sample", F.col("start").alias("event_start"), F.col("stop").alias("event_stop"), (F.col("_end") - distance).alias("start"), (F.col("_end") + distance + 1).alias("stop"))
    j = interval_join(v, ends, width=width, condition=F.col("a_sample") == F.col("b_sample"))
    return j.select(F.col("a_chrom").alias("chrom"), F.col("a_pos").alias("pos"), F.col("a_sample").alias("sample"), F.col("b_event_start").alias("event_start"), F.col("b_event_stop").alias("event_stop")).distinct()


def consensus_peaks(peaks: DataFrame, *, half: int = 250, blacklist: DataFrame | None = None, contigs: DataFrame | None = None, tile: int = 1 << 16, most_rounds: int = 1_000) -> DataFrame:
    """Fixed-width peaks around summits (contig, summit, score, id), kept greedily by score so that none overlap: contig, start, stop, score, id.

    A peak that is best among all that overlap it is kept before any of them,
    so a round keeps all such peaks at once and drops what they overlap; that
    is the greedy choice. Of peaks at one start only the best can be kept.
    Peaks that would begin before a contig are left out, those that would end
    after it (``contigs``: contig, length) are cut there. The blacklist takes
    away from what was chosen, so a peak that lost against a blacklisted one
    stays out.
    Windows run over the width of a peak within tiles, whose rows near a border
    also go to the neighbouring tile, so none spans a contig.
    """
    width = 2 * half + 1
    p = peaks.select("contig", (F.col("summit") - half).alias("start"), (F.col("summit") + half + 1).alias("stop"), F.col("score").cast("double").alias("score"), "id").where("start >= 0")
    s = Scratch(peaks.sparkSession, "peaks")
    rank = F.struct((-F.col("score")).alias("a"), F.col("id").alias("b"))
    p = p.groupBy("contig", "start").agg(F.min(rank).alias("r")).withColumn("rank", F.struct(F.col("r.a").alias("a"), F.col("start").alias("s"), F.col("r.b").alias("b"))).select("contig", "start", "rank")
    left, out = s.saved(p, "left"), None
    at = F.floor(F.col("start") / tile)

    def tiled(d: DataFrame) -> DataFrame:
        """Rows by tile, with those of other tiles within a width of it (``own`` false)."""
        near = F.array_distinct(F.array(F.floor((F.col("start") - width) / tile), at, F.floor((F.col("start") + width) / tile)))
        return d.withColumn("t", F.explode(near)).withColumn("own", F.col("t") == at)

    w = Window.partitionBy("contig", "t").orderBy("start").rangeBetween(-(width - 1), width - 1)
    for _ in range(most_rounds):
        if left.isEmpty():
            if out is None:
                out = left
            s.close()
            out = out.select("contig", "start", (F.col("start") + width).alias("stop"), (-F.col("rank.a")).alias("score"), F.col("rank.b").alias("id"))
            if contigs is not None:
                ends = contigs.select("contig", F.col("length").alias("_end"))
                out = out.join(ends, "contig", "left").withColumn("stop", F.least("stop", F.coalesce("_end", "stop"))).drop("_end")
            return out if blacklist is None else interval_anti(out, blacklist)
        now = s.saved(tiled(left).withColumn("best", F.min("rank").over(w)).where("own and rank = best").select("contig", "start", "rank"), "kept", stays=True)
        out = now if out is None else out.unionByName(now)
        marked = left.join(now.select("contig", "start", F.lit(True).alias("won")), ["contig", "start"], "left").withColumn("won", F.coalesce("won", F.lit(False)))
        left = s.saved(tiled(marked).withColumn("hit", F.max("won").over(w)).where("own and not hit").select("contig", "start", "rank"), "left", stays=True)
    raise RuntimeError("the peaks did not end")


def to_saf(peaks: DataFrame) -> DataFrame:
    """Peaks as (GeneID, Chr, Start, End, Strand), starts 1-based."""
    return peaks.select(F.concat_ws("_", "contig", "start", "stop").alias("GeneID"), F.col("contig").alias("Chr"), (F.col("start") + 1).alias("Start"), F.col("stop").alias("End"), F.lit("+").alias("Strand"))
