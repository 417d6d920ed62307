"""Text functions and language filters on literals, Indic scripts included."""


import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import language as L
from corpusloom.functions import text as T
from corpusloom.profiles import LATIN, NEPALI, TELUGU


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def many(spark, make, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r["x"] for r in df.select("i", make(F.col("c")).alias("x")).orderBy("i").collect()]


def test_whitespace(spark):
    assert one(spark, T.normalize_whitespace, "  a  b\t c \n \n\n\n d​ ") == "a b c\n\nd"
    assert one(spark, lambda c: T.normalize_whitespace(c, False), "a\n\n\nb") == "a\n\n\nb"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x1c\x85 é ", max_size=20), min_size=1, max_size=20))
def test_words_and_lines_are_pythons(spark, texts):
    assert many(spark, T.words, texts) == [t.split() for t in texts]
    assert many(spark, T.lines, texts) == [t.splitlines() for t in texts]
    assert many(spark, T.word_count, texts) == [len(t.split()) for t in texts]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12), min_size=1, max_size=15))
def test_nfc(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert many(spark, T.nfc, texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_ngrams(spark):
    assert one(spark, lambda c: T.word_shingles(T.words(c)), "a b c d") == ["a b c", "b c d"]
    assert one(spark, lambda c: T.word_shingles(T.words(c)), "a b") == ["a b"]
    assert one(spark, T.char_ngrams, "a bcd") == ["abc", "bcd"]
    assert one(spark, T.char_ngrams, " a ") == ["a"]
    assert one(spark, T.char_ngrams, "") == [""]


def test_sentences_emojis_and_digits(spark):
    assert one(spark, T.sentences, "a. b! c। d") == ["a.", "b!", "c।", "d"]
    assert one(spark, lambda c: T.remove_emojis(c, TELUGU), "a\U0001f600★b") == "ab"
    assert one(spark, T.mask_digits, " Page 12 of ౪౨ ") == "Page # of #"


@pytest.mark.parametrize(
    ("word", "profile", "bad"),
    [
        ("తెలుగు", TELUGU, False), ("ాతెలు", TELUGU, True), ("తెలు్", TELUGU, True), ("తెలుaగు", TELUGU, True), ("नेपाली", TELUGU, True), ("नेपाली", NEPALI, False),
        ("aaaa", TELUGU, True), ("...", TELUGU, True), ("hello", TELUGU, False), ("।", NEPALI, True), ("క్్్్్", TELUGU, True), ("Fähre", LATIN, False), ("a%%%%", LATIN, True),
    ],
)
def test_gibberish(spark, word, profile, bad):
    assert one(spark, lambda c: L.is_gibberish(c, profile), word) is bad


@pytest.mark.parametrize(
    ("word", "profile", "kind"),
    [
        ("తెలుగు", TELUGU, "target"), ("hello", TELUGU, "other"), ("2024.", TELUGU, "digit"), ("12,000", TELUGU, "digit"), ("6920%2040/2%06", TELUGU, "noise"),
        ("[12౧౧౭/&", TELUGU, "noise"), ("---", TELUGU, "digit"), ("౧౨.౩", TELUGU, "noise"), ("१२.३", NEPALI, "digit"), ("(5)", NEPALI, "digit"),
    ],
)
def test_classes(spark, word, profile, kind):
    assert one(spark, lambda c: L.classify(c, profile), word) == kind


def test_document_filter(spark):
    text = "తెలుగు భాష చాలా బాగుంది. This is an English sentence here.\n6920%20 [12/& 9%0/\n\nతెలుగు hello మాట 42"
    assert one(spark, lambda c: L.filter_document(c, TELUGU), text) == "తెలుగు భాష చాలా బాగుంది.\nతెలుగు మాట 42"


def test_brackets(spark):
    assert one(spark, lambda c: T.fix_ravattu_brackets(c, TELUGU), "(క్ర [x") == "క్ర [x"


def test_answers(spark):
    judge = lambda g, o, f: one(spark, lambda a, b, c: T.answer_is_correct(a, b, c, TELUGU), g, o, f)
    assert judge("44.", "44", "full") and judge("సమాధానం 44", "44", "full") and judge("స మా ధా నం4 4", "44", "full")
    assert not judge("144", "44", "full") and not judge("", "44", "full") and judge("it is Rama now", "Rama", "full")


def test_small_functions(spark):
    assert one(spark, lambda c: T.cut_at_stops(c, ["Q:"]), "a b Q: c") == "a b"
    assert one(spark, T.sample_tag, "finetuned_train_samples_2000.pt") == "2k"
    assert one(spark, T.sample_tag, "x_1500.pt") == "1.5k"
    assert one(spark, T.strip_wikitext, "{{x}}'''A''' [[b|c]] [[File:d.png]] <ref>e</ref>\n== H ==\nf") == "A c  \n\nf"
    assert one(spark, lambda c: T.join_names(F.split(c, ",")), "a,b,c") == "a, b and c"
    assert one(spark, lambda c: L.drop_short_lines(c), "a b c\n d \ne f g h\n") == "a b c\ne f g h"
    assert one(spark, lambda c: L.is_too_short(c, 3), "a b") is True
    assert one(spark, lambda c: L.strip_scan_artifacts(c), "a\n-----\n...\n© X 2020\nb") == "a\nb"
    assert one(spark, lambda c: T.label_of(T.split_prefixed_line(c)[0]), "Manual:  x") == "manual"


def test_null_texts_stay_null(spark):
    df = spark.createDataFrame([(None,)], "c string")
    for make in (T.normalize_whitespace, T.web_clean, T.mask_digits, lambda c: L.filter_document(c, LATIN)):
        assert df.select(make(F.col("c"))).first()[0] is None

