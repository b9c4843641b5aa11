import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditgrid.functions.text import first_match_line, js_regex, js_trim, line_of, match_offsets, needed_literals, shannon_entropy
from auditgrid.operators import audit
from auditgrid.plans.corpus import SNIPPETS

PATTERN = r"a+b?|\n{1,2}c|[xy]z"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("abcxyz\n😀é", max_size=40), min_size=1, max_size=30))
def test_offsets_and_lines(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", F.transform(match_offsets(F.col("t"), PATTERN), lambda m: F.struct(m["off"].alias("off"), m["text"].alias("text"), line_of(F.col("t"), m["off"]).alias("line"))).alias("m"), first_match_line(F.col("t"), PATTERN).alias("first")).collect()
    for r in got:
        text = texts[r.i]
        want = [(m.start(), m[0], text[: m.start()].count("\n") + 1) for m in re.finditer(PATTERN, text)]
        assert [tuple(m) for m in r.m] == want
        assert r.first == (want[0][2] if want else None)


def test_dialect(spark):
    def hits(text, pattern, flags=""):
        return spark.range(1).select(F.lit(text).rlike(js_regex(pattern, flags))).first()[0]

    assert hits("éa", r"\ba") and not hits("ba", r"\ba")
    assert not hits("abc\n", "c$") and hits("abc", "c$") and hits("a$", r"a\$") and hits("a$", "a[$]")
    assert hits("Ab", "aB", "i") and not hits("Ab", "aB")
    assert hits("[", "[a[]") and not hits("b", "[a[]")
    assert spark.range(1).select(js_trim(F.lit(" \t x ﻿\n"))).first()[0] == "x"


def test_entropy(spark):
    got = spark.createDataFrame([("aabc",), ("aaaa",), ("abcdefgh",), ("a+a/",)], "s string").select(shannon_entropy(F.col("s"))).collect()
    assert [round(r[0], 6) for r in got] == [1.5, 0, 3, 1.5]


def test_needed_literals_are_needed():
    """Wherever an expression matches, one of its literals occurs."""
    assert needed_literals(r"jwt\.sign\s*\(") == ("jwt.sign",)
    assert needed_literals(r"(?:md5|sha1)x?") == ("md5", "sha1")
    assert needed_literals(r"a?b*\d+") == ()
    tests = {(t.regex, t.flags) for r in (*audit.LINE_RULES, *audit.CONTENT_RULES, *audit.FILE_RULES) for t in r.gates if t.on == "content"}
    tests |= {(p.regex, p.flags) for r in (*audit.LINE_RULES, *audit.CONTENT_RULES) for p in r.patterns}
    n = 0
    for regex, flags in tests:
        literals = needed_literals(regex)
        for _, code in SNIPPETS:
            if literals and re.search(regex, code, re.ASCII | (re.I if "i" in flags else 0)):
                n += 1
                low = code.lower() if "i" in flags else code
                assert any((x.lower() if "i" in flags else x) in low for x in literals), regex
    assert n > 100
