"""What the pipeline's stages keep, row by row, where ids are null, repeated or shared."""

import random
from collections import Counter

from auditgrid.llm import exact_dedup, simhash, substring_dedup
from tests.llm.tables import corpus, frame, words
from tests.llm.test_brute_force import plain_components, plain_fingerprint


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def plain_keep_exact(rows):
    best = {}
    for n, (i, t) in enumerate(rows):
        key = (len(t or ""), i is not None, -(i or 0), -n)
        best[bare(t)] = max(best.get(bare(t), (key, i, t)), (key, i, t), key=lambda x: x[0])
    return Counter((i, t) for _, i, t in best.values())


def test_exact_keeps_one_row_of_each_group(spark):
    rows = corpus() + [(70, "said twice"), (70, "said twice"), (70, "said  twice"), (None, "no id"), (None, "no id"), (None, "noid"), (None, None), (71, "said once"), (71, "another text")]
    assert rows_of(exact_dedup.keep_one(frame(spark, rows))) == plain_keep_exact(rows)
    assert exact_dedup.keep_one(frame(spark, rows).where("false")).count() == 0


def shared_ids():
    """Rows of one id: a near copy of a smaller id, other texts, two touched texts, near copies of each other."""
    rnd = random.Random(11)
    a, b, c, d, one, two = (" ".join(words(rnd, 200)) for _ in range(6))
    rows = [(60, a), (61, a + " end"), (61, b), (61, None), (62, one), (63, "x " * 9 + one), (63, "y " * 9 + one), (63, two), (64, two), (64, c), (65, d), (65, d + " end")]
    return corpus() + rows + [(None, a), (None, one + " more")]


def plain_keep_near(rows):
    roots = plain_components([plain_fingerprint(t) for _, t in rows])
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    never, first = Counter(), {}
    for (i, t), r in zip(rows, roots, strict=True):
        if i is None:
            never[i, t] += 1
        elif i == least[r]:
            first.setdefault(r, set()).add((i, t))
    return never, list(first.values())


def test_near_keeps_one_row_of_each_component(spark):
    rows = shared_ids()
    never, first = plain_keep_near(rows)
    got = rows_of(simhash.keep_one(frame(spark, rows)))
    assert sum(got.values()) == sum(never.values()) + len(first)
    assert all(got[k] >= n for k, n in never.items())
    assert all(sum(got[k] for k in group) >= 1 for group in first)


def plain_cut(rows, window):
    first = {}
    split = [(i, t, (t or "").encode().split()) for i, t in rows]
    for i, _, ws in split:
        for k in range(len(ws) - window + 1):
            w = tuple(ws[k : k + window])
            if i is not None:
                first[w] = min(i, first.get(w, i))
    out = Counter()
    for i, t, ws in split:
        gone = {j for k in range(len(ws) - window + 1) if i is not None and first[tuple(ws[k : k + window])] < i for j in range(k, k + window)}
        out[i, b" ".join(w for j, w in enumerate(ws) if j not in gone).decode() if gone else t] += 1
    return out


def test_substring_returns_each_row_once(spark):
    rows = shared_ids()
    got = substring_dedup.without_repeats(frame(spark, rows))
    assert rows_of(got) == plain_cut(rows, substring_dedup.WINDOW)
    assert got.where("n_chars <> length(text)").count() == 0
