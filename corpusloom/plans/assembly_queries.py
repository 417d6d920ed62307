"""Queries of pages, paragraphs, labelled lines, token arrays, sources and crawls."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import structure as S
from corpusloom.operators import tokenizer as B
from corpusloom.operators import web as H
from corpusloom.operators.ordering import in_order, shared_folder
from corpusloom.plans.registry import CATEGORY_SQL, ORACLE_SQL, QUERIES, Read, category, lines_sql, query, strip_sql, words_sql
from corpusloom.profiles import LATIN
from corpusloom.sources import readers as R
from corpusloom.sources import writers as Wr

LINES = f"(SELECT doc_id, lang, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS value FROM (SELECT doc_id, lang, {lines_sql()} AS ls FROM documents))"


def doc_lines(read: Read) -> DataFrame:
    return S.split_lines(read("documents"), "doc_id", "text").withColumnRenamed("line", "value")


@query("SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INTEGER AS page_no, unnest(ps) AS page_text FROM (SELECT doc_id, string_split(text, '. ') AS ps FROM documents)")
def page_split(read: Read) -> DataFrame:
    return S.split_pages(read("documents"), "doc_id", "text", ". ")


@query(
    f"SELECT doc_id, para_no::BIGINT AS para_no, string_agg(value, chr(10) ORDER BY line_no) AS paragraph FROM (SELECT *, sum(CASE WHEN {strip_sql('value')} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS para_no FROM {LINES}) WHERE {strip_sql('value')} <> '' GROUP BY ALL"
)
def paragraphs_by_blank(read: Read) -> DataFrame:
    return S.paragraphs_by_blank(doc_lines(read), "doc_id")


#: Every seventh line is its label alone, which ends a paragraph.
LABELLED = f"(SELECT doc_id, line_no, {CATEGORY_SQL.replace('source', 'd.source')} AS prefix, CASE WHEN line_no % 7 = 6 THEN '' ELSE {strip_sql('value')} END AS content FROM {LINES} JOIN (SELECT doc_id, source FROM documents) d USING (doc_id))"


@query(
    f"SELECT doc_id, para_no::BIGINT AS para_no, 0 AS part, string_agg(content, chr(10) ORDER BY line_no) AS paragraph, arg_min(prefix, line_no) AS prefix FROM (SELECT *, sum(CASE WHEN content = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS para_no FROM {LABELLED}) WHERE content <> '' GROUP BY doc_id, para_no"
)
def paragraphs_by_prefix(read: Read) -> DataFrame:
    labels = read("documents").select("doc_id", category().alias("prefix"))
    rows = doc_lines(read).join(labels, "doc_id").withColumn("content", F.when(F.col("line_no") % 7 == 6, "").otherwise(T.strip(F.col("value"))))
    return S.paragraphs_by_prefix(rows.select("doc_id", "line_no", F.concat_ws(" ", "prefix", "content").alias("value")), "doc_id", max_lines=10**9, max_chars=10**12)


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: 'manual  ' || x), chr(10)) || chr(10) || chr(10) AS block FROM documents")
def paragraph_prefix(read: Read) -> DataFrame:
    return read("documents").select("doc_id", S.with_prefix(F.lit("manual"), F.col("text")).alias("block"))


@query(f"SELECT doc_id, line_no::INTEGER AS line_no, prefix AS category, content AS text FROM {LABELLED} WHERE content <> ''")
def labelled_lines(read: Read) -> DataFrame:
    labels = read("documents").select("doc_id", F.concat(F.upper(category()), F.lit(": ")).alias("label"))
    rows = doc_lines(read).join(labels, "doc_id").withColumn("value", F.when(F.col("line_no") % 7 == 6, F.col("label")).otherwise(F.concat("label", "value")))
    return R.labelled_lines(rows).select("doc_id", "line_no", "category", "text")


@query(f"SELECT doc_id, line_no::INTEGER AS line_no, 'public' || chr(9) || value AS value FROM {LINES} WHERE {strip_sql('value')} <> ''")
def label_lines(read: Read) -> DataFrame:
    return R.with_label(doc_lines(read), "public")


@query(f"SELECT doc_id, line_no::INTEGER AS line_no, CASE WHEN {strip_sql('value')} <> '' THEN 'manual ' || value ELSE value END AS value FROM {LINES}")
def prefix_non_blank(read: Read) -> DataFrame:
    return doc_lines(read).withColumn("value", R.prefix_non_blank(F.col("value")))


@query(f"SELECT doc_id, {strip_sql('text')} AS body FROM documents")
def text_after_tab(read: Read) -> DataFrame:
    tabbed = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("source", F.lit("\t"), "text"))
    return read("documents").select("doc_id", R.text_after_tab(tabbed).alias("body"))


@query("SELECT string_agg(text || chr(10), '' ORDER BY doc_id) AS body, lang FROM documents GROUP BY lang")
def concatenated_texts(read: Read) -> DataFrame:
    """One text a language: rows on end, a line feed after each. What is joined is what the reader asks for as one text."""
    bodies = S.texts_on_end(read("documents").withColumnRenamed("text", "body"), "lang", "doc_id", "body")
    # Rows that come from a shuffle have no more memory than they need, and the tasks that joined them are over.
    return bodies.repartition(F.xxhash64("lang"))


@query(f"SELECT doc_id, regexp_replace({strip_sql('text')}, '\\s+', ' ', 'g') AS collapsed, regexp_replace(text, '\\s+', '', 'g') AS compacted FROM documents")
def collapse_space(read: Read) -> DataFrame:
    return read("documents").select("doc_id", T.collapse(F.col("text")).alias("collapsed"), T.compact(F.col("text")).alias("compacted"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '(and .*?(\n\s*\n|\z))', '', 'gis'), '^\s+|\s+$', '', 'g') AS body FROM documents")
def boilerplate(read: Read) -> DataFrame:
    return read("documents").select("doc_id", T.remove_boilerplate(F.col("text"), ["and "]).alias("body"))


@query(f"SELECT doc_id, CASE WHEN contains(a, 'thin') THEN {strip_sql('string_split(a, ' + chr(39) + 'thin' + chr(39) + ')[1]')} ELSE a END AS answer FROM (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN {strip_sql('string_split(text, chr(10))[1]')} ELSE text END AS a FROM documents)")
def stop_strings(read: Read) -> DataFrame:
    return read("documents").select("doc_id", T.cut_at_stops(F.col("text"), ["\n", "thin"]).alias("answer"))


@query("SELECT doc_id, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n % 1000 = 0 THEN (n // 1000)::VARCHAR || 'k' ELSE (n / 1000)::VARCHAR || 'k' END AS tag FROM (SELECT doc_id, doc_id * 100 AS n FROM documents)")
def sample_tags(read: Read) -> DataFrame:
    return read("documents").select("doc_id", T.sample_tag(F.concat(F.lit("run7_samples"), (F.col("doc_id") * 100).cast("string"), F.lit(".json"))).alias("tag"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'public' WHEN 2 THEN 'manual' END AS label FROM documents")
def line_labels(read: Read) -> DataFrame:
    written = F.element_at(F.array(*map(F.lit, ("MANUAL", " Public:", ":manual :", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return read("documents").select("doc_id", T.label_of(written).alias("label"))


_ANSWERS = """
WITH items AS (SELECT item_id, regexp_replace(regexp_replace(trim(text), '\\s+', ' ', 'g'), '\\.+$', '') AS f, regexp_extract(text, '\\S+') AS o0 FROM benchmark),
given AS (SELECT item_id, f, regexp_replace(o0, '\\.+$', '') AS o,
  CASE item_id % 5 WHEN 0 THEN o0 WHEN 1 THEN 'Answer: ' || o0 WHEN 2 THEN 'nothing of it' WHEN 3 THEN f ELSE 'Answer ' || o0 || ' and more' END AS g0 FROM items),
g AS (SELECT *, regexp_replace(regexp_replace(trim(g0), '\\s+', ' ', 'g'), '\\.+$', '') AS g, replace(o, ' ', '') AS oc, replace(f, ' ', '') AS fc FROM given),
c AS (SELECT *, replace(g, ' ', '') AS gc FROM g)
SELECT item_id, g <> '' AND o <> '' AND (g = o OR g = f OR contains(g, 'Answer ' || o) OR gc = oc OR gc = fc OR contains(gc, 'Answer' || oc)
  OR (NOT regexp_matches(oc, '^[0-9]+$') AND length(oc) >= 3 AND contains(gc, oc))
  OR (contains(g, 'Answer') AND replace(regexp_replace(trim(regexp_replace(g, '^.*?Answer', '')), '\\.+$', ''), ' ', '') = oc)) AS correct FROM c
"""


@query(_ANSWERS)
def answer_match(read: Read) -> DataFrame:
    first = T.split_prefixed_line(F.col("text"))[0]
    ways = F.array(first, F.concat(F.lit("Answer: "), first), F.lit("nothing of it"), F.col("text"), F.concat(F.lit("Answer "), first, F.lit(" and more")))
    given = F.element_at(ways, (F.col("item_id") % 5 + 1).cast("int"))
    return read("benchmark").select("item_id", T.answer_is_correct(given, first, F.col("text"), LATIN).alias("correct"))


@query("SELECT lang, coalesce(arg_min(text, doc_id) FILTER (WHERE doc_id % 3 = 2 AND source = 'src4'), arg_min(text, doc_id)) AS prompt FROM documents GROUP BY lang")
def picked_prompts(read: Read) -> DataFrame:
    return read("documents").groupBy("lang").agg(T.pick_prompt(F.col("doc_id") % 3, F.col("source"), F.col("text"), F.col("doc_id"), "src4").alias("prompt"))


@query("SELECT path, (row_number() OVER (ORDER BY CASE WHEN doc_id % 5 = 0 THEN 'infinity'::DOUBLE ELSE (doc_id % 97)::DOUBLE END, path) - 1)::BIGINT AS place FROM (SELECT doc_id, source || '/' || CASE WHEN doc_id % 5 = 0 THEN lang ELSE 'part' || (doc_id % 97) || '_' || doc_id END || '.txt' AS path FROM documents)")
def numeric_path_order(read: Read) -> DataFrame:
    name = F.when(F.col("doc_id") % 5 == 0, F.col("lang")).otherwise(F.concat(F.lit("part"), (F.col("doc_id") % 97).cast("string"), F.lit("_"), F.col("doc_id").cast("string")))
    paths = read("documents").select(F.concat("source", F.lit("/"), name, F.lit(".txt")).alias("path"))
    return in_order(paths.withColumn("key", T.numeric_order(F.col("path"))), ["key"]).select("path", F.col("row").alias("place"))


IDS = f"list_transform({words_sql()}, lambda w: length(w)::INTEGER)"


def word_lengths(c: str = "text") -> Column:
    return F.transform(T.words(F.col(c)), lambda w: F.length(w))


@query(f"SELECT doc_id, list_transform({IDS}, lambda x: least(greatest(x, 0), 9)) AS ids FROM documents")
def clamped_ids(read: Read) -> DataFrame:
    return read("documents").select("doc_id", B.clamp_ids(word_lengths(), 10).alias("ids"))


@query(f"SELECT item_id, CASE WHEN len(ids) >= 8 AND ids[-4:] = ids[-8:-5] THEN ids[:len(ids) - 4] ELSE ids END AS ids FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN list_concat(a, a[-4:]) ELSE a END AS ids FROM (SELECT item_id, {IDS} AS a FROM benchmark))")
def trimmed_loops(read: Read) -> DataFrame:
    from corpusloom.operators.split import trim_loop

    a = word_lengths()
    ids = F.when(F.col("item_id") % 2 == 0, F.concat(a, F.slice(a, -4, 4))).otherwise(a)
    return read("benchmark").select("item_id", trim_loop(ids).alias("ids"))


_PACK = f"""
WITH p AS (SELECT item_id, ids[1:5] AS q, ids[6:] AS a FROM (SELECT item_id, {IDS} AS ids FROM benchmark)),
w AS (SELECT item_id, list_concat(q, a, [3]) AS whole, list_concat(list_transform(q, lambda x: -100), a, [3]) AS labels FROM p)
SELECT item_id, list_concat(whole, list_transform(range(0, 24), lambda x: 0))[1:24]::INTEGER[] AS x, list_concat(labels, list_transform(range(0, 25), lambda x: -100))[2:25]::INTEGER[] AS y FROM w
"""


@query(_PACK)
def packed_prompts(read: Read) -> DataFrame:
    ids = word_lengths()
    return read("benchmark").select("item_id", B.pack(F.slice(ids, 1, 5), F.slice(ids, 6, 10**6), 24).alias("p")).select("item_id", "p.*")


VOCAB_SQL = f"(SELECT length(w) AS id, min(w) AS token FROM (SELECT unnest({words_sql()}) AS w FROM benchmark) WHERE length(w) % 3 <> 2 GROUP BY length(w))"


@query(f"SELECT doc_id, list(coalesce(token, '<id:' || id || '>') ORDER BY pos) AS tokens FROM (SELECT doc_id, generate_subscripts(ids, 1) AS pos, unnest(ids) AS id FROM (SELECT doc_id, {IDS} AS ids FROM documents)) LEFT JOIN {VOCAB_SQL} USING (id) WHERE id >= 4 GROUP BY doc_id")
def decoded_ids(read: Read) -> DataFrame:
    words = read("benchmark").select(F.explode(T.words(F.col("text"))).alias("token"))
    vocab = words.where(F.length("token") % 3 != 2).groupBy(F.length("token").alias("id")).agg(F.min("token").alias("token"))
    return B.decode(read("documents").select("doc_id", word_lengths().alias("ids")), "doc_id", vocab)


@query("SELECT doc_id, NOT (lang = 'de' OR source IN ('src1', 'src2')) AS free FROM documents")
def open_access(read: Read) -> DataFrame:
    lending = F.when(F.col("source") == "src1", F.array(F.lit("books"), F.lit("inlibrary"))).when(F.col("source") == "src2", F.array(F.lit("printdisabled"))).otherwise(F.array(F.lit("books")))
    restricted = F.when(F.col("lang") == "de", "TRUE").when(F.col("lang") == "fr", "false")
    return read("documents").select("doc_id", H.is_open_access(restricted, lending).alias("free"))


_FILES = "(SELECT source AS item, doc_id || CASE doc_id % 4 WHEN 0 THEN '_djvu.txt' WHEN 1 THEN '_text.pdf' WHEN 2 THEN '.pdf' ELSE '.jpg' END AS name FROM documents)"
_RANKED = f"(SELECT item, name, CASE WHEN name LIKE '%djvu.txt' THEN 1 WHEN name LIKE '%\\_text.pdf' ESCAPE '\\' THEN 2 WHEN name LIKE '%.pdf' THEN 3 END AS priority FROM {_FILES})"


@query(f"SELECT item, priority, name FROM {_RANKED} WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item ORDER BY priority, name) <= 3")
def preferred_files(read: Read) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ("_djvu.txt", "_text.pdf", ".pdf", ".jpg"))), (F.col("doc_id") % 4 + 1).cast("int"))
    files = read("documents").select(F.col("source").alias("item"), F.concat(F.col("doc_id").cast("string"), ending).alias("name"))
    return H.preferred_files(files, "item", "name", 3)


_LISTS = "(SELECT doc_id % 40 AS list_page, 'u' || (doc_id % 23) AS url FROM documents)"


@query(f"WITH f AS (SELECT url, min(list_page) AS list_page FROM {_LISTS} GROUP BY url), s AS (SELECT min(l.list_page) AS stop FROM (SELECT DISTINCT list_page FROM {_LISTS}) l LEFT JOIN (SELECT DISTINCT list_page FROM f) g USING (list_page) WHERE l.list_page > 5 AND g.list_page IS NULL) SELECT list_page, url FROM f, s WHERE stop IS NULL OR list_page < stop")
def paginated_lists(read: Read) -> DataFrame:
    links = read("documents").select((F.col("doc_id") % 40).alias("list_page"), F.concat(F.lit("u"), (F.col("doc_id") % 23).cast("string")).alias("url"))
    return H.page_numbers(links)


@query("WITH c AS (SELECT range AS chunk_no, 100 + range * 37 AS first_id, least(100 + (range + 1) * 37 - 1, 799) AS last_id FROM range(19)) SELECT chunk_no, first_id, last_id, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id BETWEEN first_id AND last_id) AS n_found FROM c")
def id_range_scan(read: Read) -> DataFrame:
    return H.id_scan(read("labels"), "doc_id", 100, 799, 37)


@query("SELECT DISTINCT url FROM (SELECT url, page_id FROM pages) WHERE page_id % 5 <> 4 AND NOT regexp_matches(url, '(?i)\\.(jpe?g|png|gif|webp)$')")
def sitemap_pages(read: Read) -> DataFrame:
    """Addresses of pages in five sitemaps, of which the index names four."""
    pages = read("pages").select(F.concat(F.lit("http://x/map"), (F.col("page_id") % 5).cast("string"), F.lit(".xml")).alias("src"), F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc></url>")).alias("entry"))
    maps = pages.select(F.col("src").alias("url"), F.col("entry").alias("xml"))
    index = read("region").limit(1).select(F.lit("http://x/index.xml").alias("url"), F.lit("".join(f"<sitemap><loc>http://x/map{k}.xml</loc></sitemap>" for k in range(4))).alias("xml"))
    return H.sitemap_urls(maps.unionByName(index), index.select("url"))


def _files(spark, name: str) -> str:
    """A new folder in the session's shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def parquet_texts(spark, sf_dir: str) -> DataFrame:
    return R.parquet_texts(spark, f"{sf_dir}/documents.parquet")


def json_round_trip(spark, sf_dir: str) -> DataFrame:
    """Texts written as JSON lines and read again."""
    path = _files(spark, "json")
    Wr.write_json(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return R.jsonl_texts(spark, path)


def text_folder_lines(spark, sf_dir: str) -> DataFrame:
    """Lines of a folder of a text file a language, numbered in each file."""
    path = _files(spark, "texts")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition("lang").sortWithinPartitions("lang", "doc_id").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(path)
    lines = R.text_folder(spark, path)
    return lines.select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), F.col("line_no").cast("bigint").alias("line_no"), "value")


QUERIES |= {f.__name__: f for f in (parquet_texts, json_round_trip, text_folder_lines)}
ORACLE_SQL |= {
    "parquet_texts": f"SELECT {strip_sql('text')} AS text FROM documents WHERE {strip_sql('text')} <> ''",
    "json_round_trip": f"SELECT {strip_sql('text')} AS text FROM documents WHERE {strip_sql('text')} <> ''",
    "text_folder_lines": "SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) - 1)::BIGINT AS line_no, value FROM (SELECT doc_id, lang, generate_subscripts(ls, 1) AS i, unnest(ls) AS value FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents))",
}
