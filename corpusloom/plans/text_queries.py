"""Queries of text, structure and language filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import language as L
from corpusloom.functions import text as T
from corpusloom.operators import structure as S
from corpusloom.plans.registry import Read, lines_sql, query, quoted, strip_sql, words_sql
from corpusloom.profiles import LATIN, TELUGU


def gibberish_sql(w: str, p=LATIN) -> str:
    return (
        f"({w} = '' OR regexp_matches({w}, {quoted(f'[{p.junk}]')})"
        f" OR len(list_filter(range(1, length({w}) - 2), lambda i: {w}[i] = {w}[i + 1] AND {w}[i] = {w}[i + 2] AND {w}[i] = {w}[i + 3])) > 0"
        rf" OR regexp_replace({w}, '[\p{{Mn}}\p{{Mc}}\p{{Po}}\p{{Pc}}]', '', 'g') = ''"
        f" OR (regexp_matches({w}, {quoted(f'[{p.block}]')}) AND length({w}) > 2 AND len(regexp_extract_all({w}, {quoted(f'[{p.base}]')})) / length({w}) < 0.3))"
    )


def class_sql(w: str, p=LATIN) -> str:
    core = f"regexp_replace({w}, {quoted(f'^[{p.edge}]+|[{p.edge}]+$')}, '', 'g')"
    number = quoted(f"^[{p.digits}]+({L.NUMBER_JOIN}[{p.digits}]+)*$")
    alpha = rf"len(regexp_extract_all({w}, '\p{{L}}'))"
    symbol = quoted(rf"[^\p{{L}}\p{{N}}_{p.block}]")
    return (
        f"(CASE WHEN regexp_matches(CASE WHEN {core} = '' THEN {w} ELSE {core} END, {number}) THEN 'digit'"
        f" WHEN {alpha} = 0 AND regexp_matches({w}, {quoted(f'[{p.own_digits}]')}) AND regexp_matches({w}, {symbol}) THEN 'noise'"
        f" WHEN {alpha} = 0 THEN 'digit'"
        f" WHEN len(regexp_extract_all({w}, {quoted(f'[{p.block}]')})) / {alpha} > 0.5 THEN 'target' ELSE 'other' END)"
    )


DOC_LINES = f"SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, {lines_sql()} AS l FROM documents)"


@query(f"SELECT doc_id, line_no::INTEGER AS line_no, line FROM ({DOC_LINES})")
def doc_lines(read: Read) -> DataFrame:
    return S.split_lines(read("documents"), "doc_id", "text")


@query(
    r"SELECT doc_id, para_no::INTEGER AS para_no, paragraph FROM (SELECT doc_id, unnest(l) AS paragraph, generate_subscripts(l, 1) - 1 AS para_no"
    r" FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '\.\n', chr(10) || chr(10), 'g'), '\n{2,}') AS l FROM documents)) WHERE regexp_matches(paragraph, '\S')"
)
def paragraph_split(read: Read) -> DataFrame:
    """Lines that end a sentence end a paragraph here: the table has no blank lines."""
    spaced = read("documents").withColumn("text", F.regexp_replace("text", r"\.\n", "\n\n"))
    return S.split_paragraphs(spaced, "doc_id", "text")


@query(
    r"SELECT doc_id, (sent_no - 1)::INTEGER AS sent_no, sentence FROM (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) AS sent_no FROM"
    r" (SELECT doc_id, string_split(regexp_replace(text, '([.!?\x{0964}\x{0965}])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents))"
)
def sentence_split(read: Read) -> DataFrame:
    return read("documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sentence"))


@query(
    rf"SELECT doc_id, line_no::INTEGER AS line_no, regexp_extract({strip_sql('line')}, '^(\S+)', 1) AS prefix, regexp_replace({strip_sql('line')}, '^\S+\s*', '') AS content FROM ({DOC_LINES})"
)
def prefixed_lines(read: Read) -> DataFrame:
    prefix, content = T.split_prefixed_line(F.col("line"))
    return S.split_lines(read("documents"), "doc_id", "text").select("doc_id", "line_no", prefix.alias("prefix"), content.alias("content"))


@query(f"SELECT doc_id, array_to_string(list_filter({lines_sql()}, lambda x: len({words_sql('x')}) >= 3), chr(10)) AS text FROM documents")
def drop_short_lines(read: Read) -> DataFrame:
    return read("documents").select("doc_id", L.drop_short_lines(F.col("text")).alias("text"))


@query(f"SELECT doc_id, len({words_sql()})::INTEGER AS n_words FROM documents WHERE len({words_sql()}) < 20")
def short_documents(read: Read) -> DataFrame:
    return read("documents").where(L.is_too_short(F.col("text"))).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query(
    "SELECT doc_id, " + strip_sql(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, chr(9) || chr(160) || chr(8203) || chr(65279), '    '), ' {2,}', ' ', 'g'), ' +\n', chr(10), 'g'), '\n +', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + " AS text FROM documents"
)
def normalize_whitespace(read: Read) -> DataFrame:
    return read("documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc_normalize(read: Read) -> DataFrame:
    return read("documents").select("doc_id", T.nfc(F.col("text")).alias("text"))


@query(f"SELECT doc_id, regexp_replace(text, {quoted(f'[{LATIN.emoji}]+')}, '', 'g') AS text FROM documents")
def remove_emoji(read: Read) -> DataFrame:
    return read("documents").select("doc_id", T.remove_emojis(F.col("text"), LATIN).alias("text"))


@query(rf"SELECT doc_id, line_no::INTEGER AS line_no, regexp_replace({strip_sql('line')}, '\p{{Nd}}+', '#', 'g') AS masked FROM ({DOC_LINES})")
def mask_digits(read: Read) -> DataFrame:
    return S.split_lines(read("documents"), "doc_id", "text").select("doc_id", "line_no", T.mask_digits(F.col("line")).alias("masked"))


@query("SELECT doc_id, " + strip_sql(r"regexp_replace(regexp_replace(nfc_normalize(text), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + " AS text FROM documents")
def web_clean_text(read: Read) -> DataFrame:
    return read("documents").select("doc_id", T.web_clean(F.col("text")).alias("text"))


@query("SELECT doc_id, " + strip_sql(r"regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')") + " AS text FROM documents")
def flatten_text(read: Read) -> DataFrame:
    return read("documents").select("doc_id", T.flatten(F.col("text")).alias("text"))


@query(
    f"SELECT doc_id, n_words, n_gibberish FROM (SELECT doc_id, len(w)::INTEGER AS n_words, len(list_filter(w, lambda x: {gibberish_sql('x')}))::INTEGER AS n_gibberish"
    f" FROM (SELECT doc_id, {words_sql()} AS w FROM documents))"
)
def gibberish_words(read: Read) -> DataFrame:
    w = read("documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_words"), F.size(F.filter("w", lambda x: L.is_gibberish(x, LATIN))).alias("n_gibberish"))


@query(f"SELECT lang, kind, count(*) AS n FROM (SELECT lang, {class_sql('w')} AS kind FROM (SELECT lang, unnest({words_sql()}) AS w FROM documents)) GROUP BY ALL")
def classify_words(read: Read) -> DataFrame:
    w = read("documents").select("lang", F.explode(T.words(F.col("text"))).alias("w"))
    return w.select("lang", L.classify(F.col("w"), LATIN).alias("kind")).groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"))


def junk_sql(t: str) -> str:
    real = f"len(list_filter({t}, lambda x: NOT {gibberish_sql('x')} AND {class_sql('x')} IN ('target', 'other')))"
    return f"(len({t}) = 0 OR {real} < 1 OR {real} / len({t}) < 0.4)"


@query(f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {junk_sql('w')}) AS n_junk FROM (SELECT doc_id, {words_sql('line')} AS w FROM ({DOC_LINES})) GROUP BY doc_id")
def junk_lines(read: Read) -> DataFrame:
    rows = S.split_lines(read("documents"), "doc_id", "text").select("doc_id", T.words(F.col("line")).alias("w"))
    junk = (F.size("w") == 0) | L.is_junk(F.col("w"), LATIN)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(junk).alias("n_junk"))


def sentence_sql(s: str) -> str:
    """A sentence's kept words, '' if it is dropped."""
    clean = f"list_filter(string_split({s}, ' '), lambda y: y <> '' AND NOT {gibberish_sql('y')})"
    count = lambda kind: f"len(list_filter({clean}, lambda z: {class_sql('z')} = '{kind}'))"
    kept = f"array_to_string(list_filter({clean}, lambda z: {class_sql('z')} IN ('target', 'digit')), ' ')"
    return f"(CASE WHEN {count('other')} > {count('target')} THEN '' ELSE {kept} END)"


def filter_rows_sql(rows: str, key: str) -> str:
    """(key, kept) from rows (key, words): each sentence by itself, then joined in order by a space."""
    return f"""
      SELECT {key}, coalesce(string_agg(kept, ' ' ORDER BY i) FILTER (WHERE kept <> ''), '') AS kept FROM (
        SELECT {key}, i, {sentence_sql('s')} AS kept FROM (
          SELECT {key}, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
            SELECT {key}, string_split(regexp_replace(array_to_string(w, ' '), '([.!?\\x{{0964}}\\x{{0965}}]) ', '\\1' || chr(1), 'g'), chr(1)) AS l FROM ({rows}))))
      GROUP BY {key}"""


@query(filter_rows_sql(f"SELECT doc_id, {words_sql()} AS w FROM documents", "doc_id"))
def sentence_majority_filter(read: Read) -> DataFrame:
    return read("documents").select("doc_id", L.filter_words(T.words(F.col("text")), LATIN).alias("kept"))


def filter_document_sql(lines: str) -> str:
    """(doc_id, text) from rows (doc_id, line_no, line)."""
    rows = f"SELECT doc_id, line_no, {words_sql('line')} AS w FROM ({lines})"
    return f"""SELECT doc_id, coalesce(string_agg(kept, chr(10) ORDER BY line_no) FILTER (WHERE kept <> ''), '') AS text FROM (
      {filter_rows_sql(f"SELECT * FROM ({rows}) WHERE NOT {junk_sql('w')}", "doc_id, line_no")}) GROUP BY doc_id"""


FILTERED = filter_document_sql(DOC_LINES)


@query(f"SELECT d.doc_id, coalesce(f.text, '') AS text FROM documents d LEFT JOIN ({FILTERED}) f USING (doc_id)")
def language_filter_document(read: Read) -> DataFrame:
    return read("documents").select("doc_id", L.filter_document(F.col("text"), LATIN).alias("text"))


DENSITY_SQL = f"len(regexp_extract_all(text, {quoted(f'[{LATIN.block}]')}))::DOUBLE / greatest(length(text), 1)"


@query(f"SELECT doc_id, round({DENSITY_SQL}, 6) AS density FROM documents WHERE length(text) >= 100 AND {DENSITY_SQL} >= 0.75")
def script_density_gate(read: Read) -> DataFrame:
    return read("documents").where(L.passes_gate(F.col("text"), LATIN, 0.75, 100)).select("doc_id", F.round(L.script_density(F.col("text"), LATIN), 6).alias("density"))


HEADERS = rf"""
WITH p AS (SELECT source, doc_id, {lines_sql()} AS l FROM documents),
li AS (SELECT source, doc_id, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM p),
m AS (SELECT *, regexp_replace({strip_sql('line')}, '\p{{Nd}}+', '#', 'g') AS pattern, i < 3 AS top, i >= n - 3 AS bottom FROM li),
pages AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source),
seen AS (SELECT source, pattern, side, count(*) AS c FROM (
   SELECT DISTINCT source, doc_id, pattern, 'top' AS side FROM m WHERE top AND pattern <> '' UNION ALL
   SELECT DISTINCT source, doc_id, pattern, 'end' FROM m WHERE bottom AND pattern <> '') GROUP BY ALL),
running AS (SELECT DISTINCT source, pattern FROM seen JOIN pages USING (source) WHERE c >= greatest(2, floor(n_pages * RATIO))),
kept AS (SELECT m.*, (top OR bottom) AND (r.pattern IS NOT NULL OR regexp_matches(line, '(?i)^\s*(page\s*)?\p{{Nd}}+(\s*(of|/)\s*\p{{Nd}}+)?\s*$')) AS gone
  FROM m LEFT JOIN running r USING (source, pattern))
SELECT d.source, d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.source, d.doc_id
"""


@query(HEADERS.replace("RATIO", "0.02"))
def headers_footers(read: Read) -> DataFrame:
    """A source's documents as its pages; the ratio is low, for sources share few lines."""
    return S.strip_headers_footers(read("documents").select("source", "doc_id", "text"), "source", "doc_id", "text", ratio=0.02)


@query(rf"SELECT doc_id, array_to_string(list_filter({lines_sql()}, lambda x: NOT regexp_matches(x, '(?i)^\s*[-_=~]{{3,}}\s*$|^\s*\f\s*$|^\s*[|.]{{3,}}\s*$|^\s*©.*\d{{4}}.*$')), chr(10)) AS text FROM documents")
def scan_artifacts(read: Read) -> DataFrame:
    return read("documents").select("doc_id", L.strip_scan_artifacts(F.col("text")).alias("text"))


def cleaned(read: Read) -> DataFrame:
    """(doc_id, source, clean) of documents: short lines out, white space, language filter, NFC; the cheap steps first.

    Empty results go by way of a list of one or none, so that the filter is computed once: a
    condition on it would be moved before it and compute it again.
    """
    short = L.drop_short_lines(F.col("text"))
    some = lambda c: F.explode(F.filter(F.array(c), lambda x: x != ""))
    kept = read("documents").select("doc_id", "source", some(short).alias("clean"))
    filtered = kept.select("doc_id", "source", some(L.filter_document(T.normalize_whitespace(F.col("clean")), LATIN)).alias("clean"))
    return filtered.withColumn("clean", T.nfc(F.col("clean")))


LONG_LINES = f"SELECT doc_id, line_no, {strip_sql(r'''regexp_replace(line, ' {2,}', ' ', 'g')''')} AS line FROM ({DOC_LINES}) WHERE len({words_sql('line')}) >= 3"
CLEAN_SQL = f"SELECT doc_id, nfc_normalize(text) AS clean FROM ({filter_document_sql(LONG_LINES)})"


@query(f"SELECT doc_id, clean FROM ({CLEAN_SQL}) WHERE clean <> ''")
def clean_pipeline(read: Read) -> DataFrame:
    return cleaned(read).select("doc_id", "clean")


@query(
    r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[^\p{L}\p{N}_\-]', '_', 'g')[1:60] AS name, octet_length(encode(html)) AS n_bytes FROM pages"
)
def safe_filenames(read: Read) -> DataFrame:
    return read("pages").select("page_id", T.safe_filename(F.regexp_replace("url", r"^https?://", "")).alias("name"), F.octet_length("html").cast("bigint").alias("n_bytes"))


@query(
    rf"SELECT conv_id, turn, 'Question: ' || text || chr(10) || 'Answer:' AS prompt, array_to_string({words_sql()}[1:10], ' ') AS first_words, text[1:coalesce(nullif(strpos(text, '.'), 0), length(text) + 1) - 1] AS cut FROM conversations WHERE role = 'user'"
)
def prompts(read: Read) -> DataFrame:
    users = read("conversations").where("role = 'user'")
    return users.select("conv_id", "turn", T.prompt(F.col("text"), LATIN).alias("prompt"), T.first_words(F.col("text"), 10).alias("first_words"), F.substring_index("text", ".", 1).alias("cut"))


WIKI_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\{\{[^}]*\}\}', '', 'g'), '\[\[(?:[^\]|]*\|)?([^\]]*)\]\]', '\1', 'g'), '<[^>]+>', '', 'g'), '''{2,}', '', 'g'), '={2,}[^=]+={2,}', '', 'g'))"


@query(f"SELECT page_id, length({WIKI_SQL}) AS n_chars, md5({WIKI_SQL}) AS digest FROM pages")
def wikitext_strip(read: Read) -> DataFrame:
    plain = T.strip_wikitext(F.col("html"))
    return read("pages").select("page_id", F.length(plain).cast("bigint").alias("n_chars"), F.md5(plain.cast("binary")).alias("digest"))


_MISREAD = "(CASE doc_id % 3 WHEN 0 THEN '(క్ర ' || text WHEN 1 THEN text || ' [''ప్ర' ELSE '{కర ' || text END)"


@query(f"SELECT doc_id, regexp_replace({_MISREAD}, '[(\\[{{](['' \"‘“\\s]*[\\x{{0C15}}-\\x{{0C39}}]్\\x{{0C30}})', '\\1', 'g') AS fixed FROM documents")
def ravattu_brackets(read: Read) -> DataFrame:
    """The repair of misread brackets: before a consonant cluster with ra they go, before others they stay."""
    before = F.concat(F.lit("(క్ర "), "text"), F.concat("text", F.lit(" ['ప్ర"))
    misread = F.when(F.col("doc_id") % 3 == 0, before[0]).when(F.col("doc_id") % 3 == 1, before[1]).otherwise(F.concat(F.lit("{కర "), "text"))
    return read("documents").select("doc_id", T.fix_ravattu_brackets(misread, TELUGU).alias("fixed"))
