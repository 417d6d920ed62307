"""Word classes and language filters: OCR noise, junk lines, majority-language sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import SENTENCE_END, let, lines, remove_emojis, words
from corpusloom.profiles import LangProfile

NUMBER_JOIN = "[.,:/-]"


def is_gibberish(word: Column, p: LangProfile) -> Column:
    """Whether a word looks like scan noise."""
    has_block = word.rlike(f"[{p.block}]")
    signs = [f"[{p.junk}]", r"(.)\1{3,}", r"^[\p{Mn}\p{Mc}\p{Po}\p{Pc}]*+\z"]
    if p.dependent:
        signs.append(f"^[{p.dependent}]")
    if p.virama:
        signs.append(rf"{p.virama}\z")
    tests = word.rlike("|".join(signs))  # one pass over the word for all signs of noise
    tests |= has_block & (F.length(word) > 2) & (F.regexp_count(word, F.lit(f"[{p.base}]")) / F.length(word) < 0.3)
    if p.mixed_is_noise:
        tests |= has_block & word.rlike("[A-Za-z]")
    return tests


def classify(word: Column, p: LangProfile) -> Column:
    """target, other, digit (numbers and bare punctuation), or noise (digits among symbols)."""
    core = F.regexp_replace(word, f"^[{p.edge}]+|[{p.edge}]+$", "")
    core = F.when(core == "", word).otherwise(core)
    alpha = F.regexp_count(word, F.lit(r"\p{L}"))
    noise = word.rlike(f"[{p.own_digits}]") & word.rlike(rf"[^\p{{L}}\p{{N}}_{p.block}]")
    return (
        F.when(core.rlike(f"^[{p.digits}]+({NUMBER_JOIN}[{p.digits}]+)*$"), "digit")
        .when(alpha == 0, F.when(noise, "noise").otherwise("digit"))
        .when(F.regexp_count(word, F.lit(f"[{p.block}]")) / alpha > 0.5, "target")
        .otherwise("other")
    )


def clean_gibberish(tokens: Column, p: LangProfile) -> Column:
    return F.filter(tokens, lambda w: ~is_gibberish(w, p))


def filter_sentence(tokens: Column, p: LangProfile) -> Column:
    """The target words and numbers of a sentence, '' if other languages have the majority or nothing is left."""

    def majority(tagged: Column) -> Column:
        count = lambda kind: F.size(F.filter(tagged, lambda x: x["t"] == kind))
        kept = F.transform(F.filter(tagged, lambda x: x["t"].isin("target", "digit")), lambda x: x["w"])
        return F.when(count("other") > count("target"), "").otherwise(F.array_join(kept, " "))

    return let(F.transform(tokens, lambda w: F.struct(w.alias("w"), classify(w, p).alias("t"))), majority)


def is_junk(tokens: Column, p: LangProfile, min_ratio: float = 0.4, min_real: int = 1) -> Column:
    """Whether too few words of a line are neither noise nor numbers."""
    real = F.size(F.filter(tokens, lambda w: ~is_gibberish(w, p) & classify(w, p).isin("target", "other")))
    return let(real, lambda n: (n < min_real) | (n / F.size(tokens) < min_ratio))


def filter_words(tokens: Column, p: LangProfile) -> Column:
    """Sentence by sentence: noise words out, then sentences of other languages."""
    sentences = F.split(F.array_join(tokens, " "), rf"(?<={SENTENCE_END}) ")
    kept = F.transform(sentences, lambda s: filter_sentence(clean_gibberish(F.filter(F.split(s, " "), lambda w: w != ""), p), p))
    return F.array_join(F.filter(kept, lambda s: s != ""), " ")


def filter_document(c: Column, p: LangProfile, min_ratio: float = 0.4) -> Column:
    """Line by line: emojis out, junk lines out, the rest sentence by sentence; empty lines go.

    The same as is_junk() and filter_words() over each line's words, but each word is classed once.
    """

    def tag(w: Column) -> Column:
        return F.struct(w.alias("w"), is_gibberish(w, p).alias("noise"), classify(w, p).alias("t"), w.rlike(rf"{SENTENCE_END}\z").alias("ends"))

    def is_real(tagged: Column) -> Column:
        real = F.size(F.filter(tagged, lambda x: ~x["noise"] & x["t"].isin("target", "other")))
        return (F.size(tagged) > 0) & let(real, lambda n: (n >= 1) & (n / F.size(tagged) >= min_ratio))

    def sentence(tagged: Column) -> Column:
        count = lambda kind: F.size(F.filter(tagged, lambda x: x["t"] == kind))
        kept = F.transform(F.filter(tagged, lambda x: x["t"].isin("target", "digit")), lambda x: x["w"])
        return F.when(count("other") <= count("target"), F.array_join(kept, " ")).otherwise("")

    def in_sentences(tagged: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(tagged))
        ends = F.filter(places, lambda i: (i == F.size(tagged)) | F.get(tagged, i - 1)["ends"])
        parts = let(ends, lambda e: F.transform(e, lambda end, k: F.slice(tagged, F.when(k == 0, 1).otherwise(F.get(e, k - 1) + 1), end - F.when(k == 0, 0).otherwise(F.get(e, k - 1)))))
        texts = F.transform(parts, lambda part: let(F.filter(part, lambda x: ~x["noise"]), sentence))
        return F.array_join(F.filter(texts, lambda s: s != ""), " ")

    tagged = F.transform(lines(c), lambda line: F.transform(words(remove_emojis(line, p)), tag))
    return F.array_join(F.filter(F.transform(F.filter(tagged, is_real), in_sentences), lambda s: s != ""), "\n")


def script_density(c: Column, p: LangProfile) -> Column:
    return F.regexp_count(c, F.lit(f"[{p.block}]")) / F.greatest(F.length(c), F.lit(1))


def passes_gate(c: Column, p: LangProfile, least: float, min_length: int = 0, first_chars: int | None = None) -> Column:
    """Share of the language's characters at least `least`, in a text of at least min_length."""
    looked = F.substring(c, 1, first_chars) if first_chars else c
    return (F.length(c) >= min_length) & (script_density(looked, p) >= least)


def drop_short_lines(c: Column, min_words: int = 3, min_chars: int | None = None) -> Column:
    from corpusloom.functions.text import strip

    def long_enough(line: Column) -> Column:
        test = F.size(words(line)) >= max(1, min_words)
        return test if min_chars is None else test & (F.length(strip(line)) >= min_chars)

    return F.array_join(F.filter(lines(c), long_enough), "\n")


def is_too_short(c: Column, min_words: int = 20, min_chars: int | None = None) -> Column:
    from corpusloom.functions.text import strip, word_count

    short = word_count(c) < max(1, min_words)
    return short if min_chars is None else short | (F.length(strip(c)) < min_chars)


#: Rule lines, lone form feeds, dot and pipe leaders, copyright lines with a year.
SCAN_ARTIFACTS = [r"^\s*[-_=~]{3,}\s*$", r"^\s*\f\s*$", r"^\s*[|.]{3,}\s*$", r"^\s*©.*\d{4}.*$"]


def strip_scan_artifacts(c: Column, patterns: list[str] = SCAN_ARTIFACTS) -> Column:
    return F.array_join(F.filter(lines(c), lambda line: ~line.rlike("(?i)" + "|".join(f"(?:{x})" for x in patterns))), "\n")
