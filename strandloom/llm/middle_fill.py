"""Operator 13: fill-in-middle texts by one counted-quantifier match per row.

``regexp_count`` gives the number n of a text's units (by default a run of
letters, or any other one character). Two cut points a <= b of 0 to n are drawn
from a hash of the row's id, and a pattern made for the row,

    \\A((?:unit){a}+)((?:unit){b - a}+)(.*)\\z

captures prefix, middle and suffix in one match; the replacement string of that
same match puts them in the order of the form. The quantifiers are possessive,
which the regular expression engine runs as a loop: it keeps no way back and no
stack, so a text of millions of units needs no more than a short one.

A text that holds one of the marks, an empty text and the share ``1 - rate`` of
the others stay as they are ("plain"), so an output can always be told apart
and be turned back by ``restored`` from output and form alone: no mark can
arise across a cut, since a mark's first character occurs in it only once.

Null texts count as empty and are plain. Null ids are hashed as an empty id.
Texts are whole, of any length; units, cuts and counts are code points. Repeated
rows give equal rows, rows of one id with unlike texts are cut at their own n.
An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Beginnings of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def _drawn(id_col: str, seed: int, group: int) -> Column:
    """The ``group``-th unsigned 32-bit number of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def _laid_out(form: str, marks: tuple[str, str, str]) -> list[tuple[str, int]]:
    """Marks and the groups (1 prefix, 2 middle, 3 suffix) after them, in the order of a form."""
    p, s, m = marks
    return [(p, 1), (s, 3), (m, 2)] if form == "psm" else [(s, 3), (p, 1), (m, 2)]


def fill_in_middle(docs: DataFrame, *, rate: int = 90, spm_share: int = 20, seed: int = 1, unit: str = UNIT, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n, form, output, prefix_chars, middle_chars of every row.

    ``rate`` and ``spm_share`` are percents: of texts that are cut, and of cut
    texts whose suffix comes first. ``unit`` is a regular expression without
    groups that matches one or more characters wherever it is tried. ``marks``
    are strings whose first character doesn't recur in them.
    """
    if any(not m or m[0] in m[1:] or "\\" in m or "$" in m for m in marks) or len(set(marks)) < 3:
        raise ValueError("marks must differ, begin with a character that doesn't recur in them, and hold no backslash or dollar sign")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("*", F.regexp_count("text", F.lit(unit)).cast("long").alias("n"), *[_drawn("doc_id", seed, k).alias(f"h{k + 1}") for k in range(4)])
    marked = F.col("text") == ""
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    form = F.when(marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm_share, "spm").otherwise("psm")
    x, y = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    d = d.select("doc_id", "text", "n", form.alias("form"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    counted = [F.concat(F.lit(f"((?:{unit}){{"), n.cast("string"), F.lit("}+)")) for n in (F.col("a"), F.col("b") - F.col("a"))]
    pattern = F.concat(F.lit(r"(?s)\A"), *counted, F.lit(r"(.*)\z"))
    orders = {f: "".join(f"{m}${g}" for m, g in _laid_out(f, marks)) for f in ("psm", "spm")}
    cut = F.regexp_replace("text", pattern, F.when(F.col("form") == "psm", orders["psm"]).otherwise(orders["spm"]))
    d = d.select("doc_id", "text", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(cut).alias("output"))
    p, s, m = (F.instr("output", x).cast("long") for x in marks)
    lp, ls, lm = map(len, marks)
    prefix = F.when(F.col("form") == "psm", s - p - lp).when(F.col("form") == "spm", m - p - lp)
    middle = F.when(F.col("form") != "plain", F.char_length("output") - m - (lm - 1))
    return d.select("*", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"))


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made from."""

    def back(f: str) -> Column:
        parts = _laid_out(f, marks)
        # quoted marks; each group ends at the first occurrence of the next mark
        pattern = r"(?s)\A" + "".join(rf"\Q{m}\E(.*{'?' if k < 2 else ''})" for k, (m, _) in enumerate(parts)) + r"\z"
        at = {g: k + 1 for k, (_, g) in enumerate(parts)}
        return F.regexp_replace(output, F.lit(pattern), F.lit(f"${at[1]}${at[2]}${at[3]}"))

    return F.when(F.col(form) == "psm", back("psm")).when(F.col(form) == "spm", back("spm")).otherwise(F.col(output))
