"""Texts, words and lines of a megabyte, and columns whose names clash, for every operator."""

import hashlib
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from auditgrid.llm import best_fit_packing, bpe_replay, chat_template, exact_dedup, language_id, mixing, quality_bands, simhash, substring_dedup, token_transducer, toxicity
from tests.llm.tables import corpus, frame

N = 1_000_000
LONG = [(1, "x" * N), (2, "a1" * (N // 2)), (3, "1" * N), (4, "ab " * (N // 3)), (5, "$@" * (N // 2)), (6, "é" * (N // 2)), (7, "\n" * N), (8, "_" * N)]
LEXICON = toxicity.Lexicon({"grubel": 5.0, "aiai*": 4.0}, frozenset({"noble grubel"}))


def model(spark):
    return language_id.fit_model(spark.createDataFrame([("the cat", "en"), ("le chat", "fr")], "text string, lang string"))


OPERATORS = {
    "quality": lambda s, d: quality_bands.score_quality(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "substring": lambda s, d: substring_dedup.digests(d),
    "count": lambda s, d: token_transducer.token_counts(d),
    "exact": lambda s, d: exact_dedup.exact_duplicates(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, LEXICON),
    "packing": lambda s, d: best_fit_packing.pack(d).where("piece = 0"),
    "replay": lambda s, d: bpe_replay.encoding_digests(d),
    "language": lambda s, d: language_id.predict_language(d, model(s)),
    "mix": lambda s, d: mixing.mix(d),
    "keep_clean": lambda s, d: toxicity.keep_clean(d, LEXICON, 1.1),
    "without_repeats": lambda s, d: substring_dedup.without_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_megabytes_in_one_word_or_line(spark, name):
    OPERATORS[name](spark, frame(spark, [(1, "warm up")])).count()
    began = time.monotonic()
    assert len(OPERATORS[name](spark, frame(spark, LONG, 4)).collect()) == len(LONG)
    assert time.monotonic() - began < 60


def test_folding_and_phrases_take_linear_time():
    began = time.monotonic()
    for _, text in LONG:
        toxicity.fold(text)
        toxicity.fold(text + "1")
    text = "grubel" + " " * N + "grubel " + "x" * N
    LEXICON.matches(text, LEXICON.automaton())
    assert toxicity.phrases(text, 0) == ["grubel grubel"] and toxicity.phrases("noble" + "é" * 200 + " grubel", 206) == ["noble" + "é" * 200 + " grubel"]
    assert time.monotonic() - began < 10


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name(spark, name):
    """Columns named as those that operators use inside change nothing."""
    docs = frame(spark, corpus()[:20])
    more = docs.withColumns({c: F.lit(7) for c in ("row", "row_number", "fp_", "key", "kept", "copy", "of_id", "of_tag", "words", "words_sha", "anchor", "score", "root", "rep", "length", "part", "nth", "ids", "hash", "block", "name", "size", "sha", "label")})
    plain, got = OPERATORS[name](spark, docs), OPERATORS[name](spark, more)
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect())) if name != "packing" else got.count() == plain.count()


def test_conversations_of_megabytes_and_columns_of_any_name(spark):
    turns = [(c, t, role, text) for c, (_, text) in enumerate(LONG) for t, role in enumerate(("user", "assistant"))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    more = df.withColumns({c: F.lit(7) for c in ("last", "formatted", "mask", "n_turns", "loss", "base", "piece")})
    began = time.monotonic()
    plain, got = (sorted(map(tuple, chat_template.read_back(chat_template.format_conversations(x)).collect())) for x in (df, more))
    assert plain == got and time.monotonic() - began < 60
    loss = {r[0]: r[4] for r in plain}
    assert loss == {c: hashlib.sha256(text.encode()).hexdigest() for c, (_, text) in enumerate(LONG)}


def test_keep_one_passes_columns_of_any_name_through(spark):
    docs = frame(spark, corpus()[:20]).withColumns({c: F.lit(7) for c in ("row", "row_number", "row_number_", "root", "rep", "name", "kept", "component_id_")})
    for keep in (exact_dedup.keep_one, simhash.keep_one):
        got = keep(docs)
        assert got.columns == docs.columns and 0 < got.count() <= 20 and got.where("row_number = 7").count() == got.count()


def test_one_long_word_has_the_library_s_tokens():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    machine, library = token_transducer.Transducer(path), Tokenizer.from_file(path)
    for text in ("x" * 20_001, "ab" * 9000 + " c", "the quick " + "antidisestablishmentarianism" * 700, "q" * 300 + "é" * 5000):
        assert token_transducer.count_tokens([text], machine) == [len(library.encode(text, add_special_tokens=False).ids)]
        assert token_transducer.encode([text], machine)[0].tolist() == library.encode(text, add_special_tokens=False).ids
