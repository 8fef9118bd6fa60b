"""Operator 12: quality rules under weak supervision, in Spark's own functions only.

Every rule looks at a few counts of a text and votes good (1), bad (-1) or
abstains (0). Which votes to trust is learned without labels. The model is a
naive mixture of two classes: a rule that votes gives the right vote with one
probability on good texts and with another on bad ones, and abstaining says
nothing. Expectation-maximisation needs no more than how often each pattern of
votes occurs over all texts, which is a table of at most 3^rules rows whatever
the corpus holds; its rounds are one expression over that table as a single
row. A text's posterior probability of being good then decides, instead of
asking every rule to pass. A rule that would come out worse than chance is held
at chance, so that "good" keeps the meaning that the rules give it.

Counts of a text: words are [^\\x20\\x09-\\x0D]+; lines are split at \\n and have
a word. Words in repeated windows are found by sorting the 64-bit hashes of all
windows of the text, and only where two of them are equal.

Null texts count as empty: they have no words and fail the base rules, as does
a text of fewer than ``least_words`` words. Texts are whole, of any length
(one text's words are one array in a task). Rows are judged one by one, so
repeated rows and null ids get results like others; an empty table gives no
rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.scratch import Scratch

SEPARATORS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letters", "n_lettered", "n_ends")
ROUNDS = 60
#: Rules are made so as to accuse few good texts, and each to see one kind of fault. What the rounds begin with, and the weight, in texts, of it in every round: right votes on good and on bad texts, and the share of good texts.
RIGHT_GOOD, RIGHT_BAD, SHARE, PRIOR_TEXTS = 0.98, 0.2, 0.8, 2.0


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _chars(text: Column, but: str) -> Column:
    """How many characters of a text lie outside the pattern ``but``."""
    return F.char_length(F.regexp_replace(text, F.lit(but), F.lit(""))).cast("long")


def _split(bare: Column) -> Column:
    """The words of a text without separators at its ends."""
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words within windows that occur twice or more, each word once, from the hashes of a text's words."""

    def covered(at: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("end"))
        add = lambda s, i: F.struct((s.words + i + window - F.greatest(s.end, i)).alias("words"), (i + window).alias("end"))
        return F.aggregate(at, none, add, lambda s: s.words)

    def equal(sorted_: Column) -> Column:
        same = lambda x, k: (F.get(sorted_, k - 1).h == x.h) | (F.get(sorted_, k + 1).h == x.h)
        return covered(F.sort_array(F.transform(F.filter(sorted_, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x.at)))

    def found(w: Column) -> Column:
        by_hash = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(by_hash, equal))

    windows = lambda: F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))
    return F.when(F.size(hashes) <= window, F.lit(0).cast("long")).otherwise(let(windows(), found))


def text_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ``COUNTS`` of every row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text, long = F.col("text"), lambda c: c.cast("long")
    words = let(F.btrim(text, F.lit(SEPARATORS)), _split)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    of_words = lambda h: F.struct(long(F.size(h)).alias("n_words"), repeated_words(h).alias("n_repeat_words"), long(F.size(F.array_distinct(h))).alias("n_distinct"))
    of_lines = lambda x: F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    of_letters = lambda x: F.struct(long(F.char_length(x)).alias("chars"), long(F.size(let(F.btrim(x, F.lit(SEPARATORS)), _split))).alias("n_lettered"))
    d = d.select(
        "doc_id",
        let(F.transform(words, lambda x: F.xxhash64(x)), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        long(F.char_length(text)).alias("chars"),
        _chars(text, r"[^\x20\x09-\x0D]+").alias("gaps"),
        _chars(text, "[^#*$%&|<>]+").alias("n_symbols"),
        let(F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D]+", ""), of_letters).alias("c"),
        long(F.regexp_count(text, F.lit("[.!?]"))).alias("n_ends"),
    )
    d = d.select("doc_id", "w.*", "l.*", (F.col("chars") - F.col("gaps")).alias("word_chars"), "n_symbols", (F.col("c.chars") - F.col("gaps")).alias("n_letters"), "c.n_lettered", "n_ends")
    return d.select("doc_id", *COUNTS)


#: Rules as (name, votes good where, votes bad where), conditions over the counts; a rule abstains where neither holds.
RULES: tuple[tuple[str, str, str], ...] = (
    ("length", "n_words >= 50", "n_words < 20"),
    ("word_length", "word_chars between 3 * n_words and 8 * n_words", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    ("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("same_lines", "n_lines >= 2 and 10 * n_dup_lines <= n_lines", "n_dup_lines >= 2 and 10 * n_dup_lines > 4 * n_lines"),
    ("same_windows", "n_words >= 20 and 10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    ("vocabulary", "n_words >= 20 and n_distinct * n_distinct >= 9 * n_words", "n_distinct * n_distinct < 4 * n_words"),
    ("letters", "100 * n_letters >= 85 * word_chars", "100 * n_letters < 70 * word_chars"),
    ("words_with_letters", "10 * n_lettered >= 9 * n_words", "10 * n_lettered < 8 * n_words"),
    ("sentences", "n_ends >= 1 and n_words <= 40 * n_ends", "n_words >= 50 and n_words > 200 * n_ends"),
)


def votes(rules=RULES) -> Column:
    """The array of votes, one of 1, -1 and 0 for each rule."""
    return F.array(*[F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for _, good, bad in rules])


def _fitted(patterns: Column, rules: int, rounds: int) -> Column:
    """struct(share, good, bad) after ``rounds`` rounds over an array of struct(votes, n)."""
    each, start = F.sequence(F.lit(0), F.lit(rules - 1)), lambda x: F.array_repeat(F.lit(x), F.lit(rules))

    def total(xs: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda s, x: s + of(x))

    def learned(xs: Column) -> Column:
        """New chances from an array of struct(votes, good, bad): texts of a pattern by class."""

        def of_rule(j: Column) -> Column:
            vote = lambda x: F.get(x.votes, j)
            when = lambda x, v, c: F.when(vote(x) == v, c).otherwise(F.lit(0.0))
            up, down = total(xs, lambda x: when(x, 1, x.good)), total(xs, lambda x: when(x, -1, x.good))
            up_bad, down_bad = total(xs, lambda x: when(x, 1, x.bad)), total(xs, lambda x: when(x, -1, x.bad))
            good = (up + PRIOR_TEXTS * RIGHT_GOOD) / (up + down + PRIOR_TEXTS)
            bad = (down_bad + PRIOR_TEXTS * RIGHT_BAD) / (up_bad + down_bad + PRIOR_TEXTS)
            return F.struct(good.alias("good"), F.greatest(bad, 1 - good).alias("bad"))

        good, bad = total(xs, lambda x: x.good), total(xs, lambda x: x.bad)
        share = (good + PRIOR_TEXTS * SHARE) / (good + bad + PRIOR_TEXTS)
        chance = lambda r: F.struct(share.alias("share"), F.transform(r, lambda x: x.good).alias("good"), F.transform(r, lambda x: x.bad).alias("bad"))
        return let(F.transform(each, of_rule), chance)

    def one_round(model: Column, _: Column) -> Column:
        split = lambda odds: F.transform(patterns, lambda x: let(_posterior(x.votes, odds), lambda q: F.struct(x.votes.alias("votes"), (x.n * q).alias("good"), (x.n * (1 - q)).alias("bad"))))
        return let(let(_odds(model), split), learned)

    first = F.struct(F.lit(SHARE).alias("share"), start(RIGHT_GOOD).alias("good"), start(RIGHT_BAD).alias("bad"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, one_round)


def _odds(model: Column) -> Column:
    """struct(share, up, down): the logarithms that the share and the votes add."""
    up = F.zip_with(model.good, model.bad, lambda g, b: F.log(g / (1 - b)))
    down = F.zip_with(model.good, model.bad, lambda g, b: F.log((1 - g) / b))
    return F.struct(F.log(model.share / (1 - model.share)).alias("share"), up.alias("up"), down.alias("down"))


def _posterior(v: Column, odds: Column) -> Column:
    add = lambda s, x: s + F.when(x.v == 1, x.up).when(x.v == -1, x.down).otherwise(F.lit(0.0))
    rows = F.arrays_zip(v.alias("v"), odds.up.alias("up"), odds.down.alias("down"))
    return 1 / (1 + F.exp(-F.aggregate(rows, odds.share, add)))


def fit(voted: DataFrame, *, rules: int = len(RULES), rounds: int = ROUNDS) -> DataFrame:
    """One row (share, good, bad): the share of good texts and each rule's chances of a right vote on good and on bad ones, from a column ``votes``."""
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))  # at most 3^rules
    return one.select(_fitted(F.col("patterns"), rules, rounds).alias("m")).select("m.*")


def judged(docs: DataFrame, *, rules=RULES, rounds: int = ROUNDS, threshold: float = 0.5, least_words: int = 20, most_repeated: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the ``COUNTS``, votes, base_failed, posterior and kept of every row. ``most_repeated`` is a percent of a text's words."""
    s = Scratch(docs.sparkSession, "weak_rules")
    counts = text_counts(docs, id_col=id_col, text_col=text_col).withColumn("votes", votes(rules))
    counts = s.saved(counts, "counts", stays=True)
    model = s.saved(fit(counts, rules=len(rules), rounds=rounds), "model", stays=True)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    odds = model.select(_odds(F.struct("share", "good", "bad")).alias("odds"))
    d = counts.crossJoin(F.broadcast(odds))  # one row
    d = d.withColumn("base_failed", failed).withColumn("posterior", _posterior(F.col("votes"), F.col("odds"))).drop("odds")
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
