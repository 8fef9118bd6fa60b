"""Fill-in-middle against a plain version, with the odd rows of a table."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from strandloom.llm import middle_fill

SCHEMA = "doc_id long, text string, n long, form string, output string, h1 string"


def plain(i, text):
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    n, text = len(units), text or ""
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    if h[3] % 100 < 20:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_equals_the_plain_version_and_turns_back(spark):
    random.seed(13)
    parts = ["word", "Ab", " ", "\n", "\r", " ", "é", "ß", "\U0001f600", "<", "P", ">", "<S", "M>", "$1", "\\", "{2}", "\0", "9"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(400)] + ["<P>", "a<S>b", "x<M>", "", None, "q", "wor d! \U0001f600" * 60_000]
    rows = [(k, t, 7, "f", "o", "h") for k, t in enumerate(texts)] + [(None, "no id", 1, "", "", ""), (3, texts[3], 7, "f", "o", "h"), (3, "other text", 7, "f", "o", "h")]
    got = middle_fill.fill_in_middle(spark.createDataFrame(rows, SCHEMA)).withColumn("back", middle_fill.restored()).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in got), key=str) == sorted(((r[0], *plain(*r[:2])) for r in rows), key=str)
    assert all(r.back == r.text for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_marks_shares_and_units(spark):
    d = spark.createDataFrame([(k, "uno dos tres. cuatro", 0, "", "", "") for k in range(50)], SCHEMA)
    got = middle_fill.fill_in_middle(d, rate=100, spm_share=100, unit=r"[\s\S]", marks=("[pre]", "[suf]", "[mid]")).withColumn("back", middle_fill.restored(marks=("[pre]", "[suf]", "[mid]"))).collect()
    assert all(r.form == "spm" and r.n == 20 and r.back == r.text and r.output.startswith("[suf]") for r in got)
    assert {r.form for r in middle_fill.fill_in_middle(d, rate=0).collect()} == {"plain"}
    for marks in (("<P>", "<P>", "<M>"), ("aba", "c", "d"), ("", "c", "d"), ("$1", "c", "d")):
        with pytest.raises(ValueError):
            middle_fill.fill_in_middle(d, marks=marks)
    assert middle_fill.fill_in_middle(d.limit(0)).count() == 0
