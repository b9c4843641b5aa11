import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditgrid.llm import chat_template, common, language_id, toxicity
from tests.llm.tables import corpus, frame, words

DATA = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    got = toxicity.op6_toxicity_lexicon(spark, DATA).join(common.read(spark, DATA, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert len(got) > 50 and right / len(got) > 0.95
    assert sum(r.predicted for r in got if r.toxic) >= 0.8 * sum(r.toxic for r in got)


def test_toxicity_terms_fold_and_exceptions(spark):
    lexicon = toxicity.Lexicon({"idiot": 5.0, "lowe*": 4.0}, frozenset({"noble idiot"}), (-5.0, 2.0, 1.0))
    auto = lexicon.automaton()

    def total(text):
        return sum(w for w, _ in lexicon.matches(toxicity.fold(text), auto).values())

    assert total("An IDIOT, idiot!") == 10
    assert total("1d10t іdіоt idi0t") == 15
    assert total("loweicht followed slowe") == 4
    assert total("a noble idiot here; idiots idiotic") == 0
    assert toxicity.fold("in 2024 at 10") == "in 2024 at 10"
    assert toxicity.fold(None) == ""


def test_toxicity_learns_beginnings_and_ignores_copies(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        text = words(rnd, 60)
        toxic = i % 5 == 0
        if toxic:
            text[10] = text[30] = "grubel" + rnd.choice("abcdefgh") + rnd.choice("mnop")
        rows.append((i, " ".join(text), int(toxic)))
    copied = " ".join([*words(rnd, 60), "harmless"])
    rows += [(1000 + i, copied, 1) for i in range(50)]
    lexicon = toxicity.fit_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert "grub*" in lexicon.terms and "harmless" not in lexicon.terms
    empty = toxicity.fit_lexicon(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    docs = frame(spark, corpus())
    assert toxicity.score_toxicity(docs, empty).select("score").distinct().count() == 1
    assert toxicity.score_toxicity(docs, lexicon).count() == docs.count()
    assert toxicity.score_toxicity(docs.where("false"), lexicon).count() == 0


def test_language_held_out(spark):
    truth = common.documents(spark, DATA).select("doc_id", "lang")
    got = language_id.op10_word_backoff(spark, DATA).join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.9


def test_language_edges(spark):
    rows = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "de"), ("x", None)], "text string, lang string")
    model = language_id.fit_model(rows)
    assert model.langs == ["en", "fr"]
    docs = frame(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "the dog"), (5, "le chien"), (6, "doggy catty"), (None, "ñ")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_language(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == got[6][0] == "en" and got[5][0] == "fr"
    assert got[None][0] in ("en", "fr") and all(0 <= s <= 1 for _, s in got.values())
    numerals = {r.doc_id: r.lang_pred for r in language_id.predict_language(frame(spark, [(1, "² ½"), (2, "Ⅷ ①"), (3, "² the")]), model).collect()}
    assert numerals == {1: "und", 2: "und", 3: "en"}
    nothing = language_id.fit_model(rows.where("false"))
    assert {r.lang_pred for r in language_id.predict_language(docs, nothing).collect()} == {"und"}


def test_predictor_with_a_small_memory(spark):
    rows = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr")], "text string, lang string")
    model = language_id.fit_model(rows)
    text = " ".join(words(random.Random(1), 500))
    large, small = language_id.Predictor(model).predict(text), language_id.Predictor(model, keep=3).predict(text)
    assert large[0] == small[0] and large[1] == pytest.approx(small[1])


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_escapes_are_reversible_and_leave_no_control_string(text):
    for f in (chat_template.escape, chat_template.escape_line):
        assert chat_template.unescape(f(text)) == text
        assert not set("<>[]|") & set(f(text))


def test_templates():
    def out(source, **names):
        return "".join(t for t, _ in chat_template.compile_template(source)(names.pop("messages", []), **names))

    msgs = [{"role": "user", "text": " hi "}, {"role": "assistant", "text": "yo"}]
    assert out("{% for m in messages %}{{ loop.index }}{{ m.text | trim }}{% if not loop.last %}, {% endif %}{% endfor %}", messages=msgs) == "1hi, 2yo"
    assert out("{% if a == 1 and b %}x{% elif a > 1 %}y{% else %}z{% endif %}", a=2, b=False) == "y"
    assert out("{% set q = 'a' ~ 'b' %}{{ q + 'c' | upper }} {{- '!' }}") == "abC!"
    assert out("{{ m['role'] }}{{ 'x' in 'xyz' }}", m={"role": "r"}) == "rTrue"
    tree = chat_template.fold_constants(chat_template.parse("a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{% else %}{{ d }}{% endif %}"))
    assert tree == (chat_template.Output(chat_template.Literal("ab1c")),)
    for bad in ("{{ a.__class__ }}", "{{ _x }}", "{{ f() }}", "{% import os %}", "{% for x in y %}", "{{ a | eval }}", "{{ a ; b }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.parse(bad)
    with pytest.raises(chat_template.TemplateError):
        out("{{ f.real }}", f=3)


def plain_conversation(turns):
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("piece_chars", [100_000, 5])
def test_conversations(spark, piece_chars):
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(("user", "assistant", "sys\ntem", None, "<|turn|>")), rnd.choice((None, "", "hi", "a\nb", "<|end|>\n<|turn|>x\n", "&n&l&a", chat_template.HOSTILE, "long " * 50))) for c in (1, 2, 3, None) for t in range(9)]
    rows += rows[:4] + [(4, None, "user", "no turn"), (4, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1)).repartition(3)
    got = chat_template.read_back(chat_template.format_conversations(df, piece_chars=piece_chars)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    by = {}
    for c, *turn in sorted(rows, key=key):
        by.setdefault(c, []).append(turn)
    assert {r.conv_id: tuple(r)[1:5] for r in got} == {c: plain_conversation(t) for c, t in by.items()}
    assert len(got) == len(by)
    assert chat_template.read_back(chat_template.format_conversations(df.where("false"))).count() == 0


def test_the_query_formats_every_conversation_and_the_hostile_one(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: tuple(r)[1:5] for r in chat_template.op9_template_compiler(spark, sf).collect()}
    by = {-7: [[0, "user", chat_template.HOSTILE], [1, "assistant", chat_template.HOSTILE]]}
    for r in common.read(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append([r.turn, r.role, r.text])
    assert got == {c: plain_conversation(t) for c, t in by.items()}


def plain_fold(text):
    """Word by word: one that has letters gets letters for its digits and signs, where a digit or sign follows its beginning of letters."""
    text = "".join(toxicity.HOMOGLYPHS.get(c, c) if not text.isascii() else c for c in text.lower())
    out, word = [], []
    for c in [*text, None]:
        if c is not None and (c.isalnum() or c in "_@$"):
            word.append(c)
            continue
        mixed = any(x.isdecimal() or x in "@$" for x in word) and any(x.isalpha() for x in word) and any(x in "0134578@$" for x in word)
        out += [toxicity.DIGITS.get(x, x) if mixed else x for x in word]
        out += [c] if c is not None else []
        word = []
    return "".join(out)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1d10t 0358@$_.-éаеİ²")))
def test_fold_is_that_of_plain_words(text):
    assert toxicity.fold(text) == plain_fold(text.replace("İ", "i̇")) or "İ" in text


def plain_matches(text, terms, exceptions):
    words, word = [], ""
    for c in text + " ":
        if c.isalnum():
            word += c
        elif word:
            words.append(word)
            word = ""
    total = 0.0
    for i, w in enumerate(words):
        best = max((v for t, v in terms.items() if w == t or t.endswith("*") and w.startswith(t[:-1])), default=0.0)
        near = [" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j and j + 2 <= len(words)]
        if best > 0 and not any(p in exceptions for p in near):
            total += best
    return total


def test_toxicity_fit_and_scores_by_brute_force(spark):
    """Counts, odds, exceptions and scores again in plain Python; only the curve's three numbers are taken as fitted."""
    rnd = random.Random(12)
    rows = []
    for i in range(300):
        text = words(rnd, 40)
        toxic = int(i % 6 == 0)
        if toxic:
            text[5] = text[20] = "grubel" + rnd.choice("abc")
        elif i % 20 == 1:
            text[6:8] = ["noble", "grubela"]
        rows.append((i, " ".join(text), toxic))
    rows += [(500, None, 0), (501, "", 0), (502, "grubela " + "x" * 200 + " y", 1), (503, "no label", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit_lexicon(table)
    counted = {}
    for i, text, toxic in rows:
        if toxic is not None:
            folded = plain_fold(text or "")
            found = {w for w in "".join(c if c.isalnum() else " " for c in folded).split() if len(w) > 2}
            marks = tuple(toxicity._copies_mark(folded))
            counted.setdefault(marks, (toxic, found | {w[:k] + "*" for k in (4, 5, 6) for w in found if len(w) >= k}))
    n1, n0 = (sum(t == k for t, _ in counted.values()) for k in (1, 0))
    t, n = {}, {}
    for toxic, found in counted.values():
        for x in found:
            n[x] = n.get(x, 0) + 1
            t[x] = t.get(x, 0) + toxic
    import math

    odds = {x: math.log((t[x] + 0.5) / (n1 + 1)) - math.log((n[x] - t[x] + 1.0) / (n0 + 2)) for x in n}
    want = {x: v for x, v in odds.items() if t[x] >= max(5, 0.01 * n1) and v >= 3.5}
    assert want and lexicon.terms == pytest.approx(want)
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(table, lexicon).collect()}
    a, b, c = lexicon.curve
    for i, text, _ in rows:
        folded = plain_fold(text or "")
        total = plain_matches(folded, lexicon.terms, lexicon.exceptions)
        x, y = math.log1p(total), math.log1p(100 * total / max(1, len(folded.split())))
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-(a + b * x + c * y))))
    clean = toxicity.keep_clean(table, lexicon).collect()
    assert sorted(r.doc_id for r in clean) == sorted(i for i, s in scored.items() if s < toxicity.THRESHOLD) and 0 < len(clean) < len(rows)


def test_fits_do_not_depend_on_partitions(spark):
    rnd = random.Random(3)
    rows = [(i % 250, " ".join([*words(rnd, 30), *(["grubel"] * (i % 5 == 0))]), int(i % 5 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    one, many = (toxicity.fit_lexicon(table.repartition(n)) for n in (1, 60))
    assert one.terms == many.terms and one.curve == many.curve and one.exceptions == many.exceptions
    docs = table.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("lang"))
    first, second = (language_id.predict_language(docs, language_id.fit_model(docs.repartition(n))).orderBy("doc_id", "score").collect() for n in (1, 60))
    assert first == second


def test_language_scores_by_brute_force(spark):
    import math
    from collections import Counter

    rnd = random.Random(8)
    rows = [(" ".join(words(rnd, 12)) + " le chat", "fr") for _ in range(20)] + [(" ".join(words(rnd, 9)) + " the dog", "en") for _ in range(15)] + [("Straße über", "de"), ("² 12", "de"), (None, "xx"), ("x", None)]
    model = language_id.fit_model(spark.createDataFrame(rows, "text string, lang string"))
    split = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    grams = lambda w, k: [w] if k == 0 else list(w) if k == 1 else [f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)]
    counts = {k: {x: Counter() for x in ("de", "en", "fr")} for k in range(6)}
    for text, lang in rows:
        for w in split(text) if lang else ():
            for k in counts:
                counts[k][lang].update(grams(w, k))
    terms = {k: set().union(*c.values()) for k, c in counts.items()}
    assert model.langs == ["de", "en", "fr"]
    docs = [(1, "the chat"), (2, "unknownword thedog"), (3, "Ölig straßen"), (4, "qqqq"), (5, "7 ²"), (6, " ".join(words(rnd, 50)))]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_language(frame(spark, docs), model).collect()}
    for i, text in docs:
        total = dict.fromkeys(model.langs, 0.0)
        for w in split(text):
            k = next((k for k in (0, 5, 4, 3, 2, 1) if any(g in terms[k] for g in grams(w, k))), None)
            for x in total if k is not None else ():
                total[x] += sum(math.log((counts[k][x][g] + 0.5) / (counts[k][x].total() + 0.5 * max(1, len(terms[k])))) for g in grams(w, k) if g in terms[k])
        if not split(text):
            assert got[i] == ("und", 0.0)
            continue
        top = max(total.values())
        assert got[i][0] == next(x for x in sorted(total) if total[x] == top) or got[i][1] < 0.34
        assert got[i][1] == pytest.approx(1 / sum(math.exp(v - top) for v in total.values()), rel=1e-3)


def test_samples_of_any_table_are_bounded_and_never_empty(spark):
    for n in (1, 10**6, 10**12, 10**16):
        bound = common.sample_bound(n, 16_000)
        share = (bound + 2**63) / 2**64
        assert 0 < share and share * n == pytest.approx(min(n, 16_000), rel=1e-6)
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert 800 < common.bounded_sample(rows, 1000, "doc_id").count() < 1200
    assert common.bounded_sample(rows, 30_000, "doc_id").count() == 20_000
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(3000)] + [(7, "hot", "fr")] * 3000 + [(None, "no id", "de"), (1, None, "de")], "doc_id long, text string, lang string")
    kept = {r.lang: r["count"] for r in language_id.training_rows(docs, 500).groupBy("lang").count().collect()}
    assert 400 < kept["en"] < 600 and kept["de"] == 1 and kept.get("fr", 0) <= 1
    hot = toxicity.training_rows(docs, spark.createDataFrame([(7, 0, 0), (7, 0, 1), (8, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")).collect()
    assert {(r.doc_id, r.text, r.toxic) for r in hot} <= {(7, "hot", 1), (8, "text 8", 0)}


def test_a_worker_keeps_one_state():
    made = []
    for key in ("a", "a", "b", "a"):
        common.worker_state((key,), lambda: made.append(key) or key)
    assert made == ["a", "b", "a"] and len(common._STATE) == 1
    common.release_state()
    assert not common._STATE
