"""Queries of tokenizer, training, attention and crawl reports, and of batches and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import metrics as M
from corpusloom.operators import split as W
from corpusloom.operators import stats as A
from corpusloom.operators import tokenizer as B
from corpusloom.operators import web as H
from corpusloom.operators.ordering import in_order
from corpusloom.plans.assembly_queries import LINES, doc_lines
from corpusloom.plans.registry import CATEGORY_SQL, Read, category, query, strip_sql
from corpusloom.plans.stats_queries import PIECES_SQL, WORDS_N

#: A vocabulary of the pieces that stand at least ten times in the corpus; other pieces are unknown.
VOCAB = f"(SELECT token FROM (SELECT unnest({PIECES_SQL}) AS token FROM documents) GROUP BY token HAVING count(*) >= 10)"
TOKENS = f"(SELECT doc_id, list(coalesce(v.token, '<unk>') ORDER BY pos) AS tokens FROM (SELECT doc_id, generate_subscripts(ps, 1) AS pos, unnest(ps) AS token FROM (SELECT doc_id, {PIECES_SQL} AS ps FROM documents)) t LEFT JOIN {VOCAB} v USING (token) GROUP BY doc_id)"


def vocabulary(read: Read) -> DataFrame:
    return A.token_frequency(read("documents"), A.pieces(F.col("text"))).where("n >= 10").select("token")


def tokenized(read: Read) -> DataFrame:
    return B.known_pieces(read("documents"), "doc_id", A.pieces(F.col("text")), vocabulary(read))


@query(f"SELECT doc_id, tokens FROM {TOKENS}")
def vocabulary_tokens(read: Read) -> DataFrame:
    return tokenized(read)


@query(f"SELECT sum(w)::BIGINT / sum(len(tokens))::BIGINT AS words_per_token, sum(len(tokens))::BIGINT / sum(w)::BIGINT AS fertility, sum(len(list_filter(tokens, lambda t: t = '<unk>')))::BIGINT / sum(len(tokens))::BIGINT AS unk_rate FROM {TOKENS} JOIN (SELECT doc_id, {WORDS_N} AS w FROM documents) USING (doc_id)")
def unknown_report(read: Read) -> DataFrame:
    words = read("documents").select("doc_id", T.word_count(F.col("text")).alias("w"))
    encoded = tokenized(read).join(words, "doc_id")
    report = B.unk_report(encoded, "w", "tokens")
    return report.select((1 / F.col("fertility")).alias("words_per_token"), "fertility", "unk_rate")


@query(f"SELECT {CATEGORY_SQL} AS category, count(*) FILTER (WHERE list_contains(tokens, '<unk>')) AS n_unknown_lines, count(*) AS n_lines FROM {TOKENS} JOIN documents USING (doc_id) GROUP BY ALL")
def unknown_lines(read: Read) -> DataFrame:
    unknown = F.count_if(F.array_contains("tokens", "<unk>"))
    joined = tokenized(read).join(read("documents").select("doc_id", category().alias("category")), "doc_id")
    return joined.groupBy("category").agg(unknown.alias("n_unknown_lines"), F.count(F.lit(1)).alias("n_lines"))


@query(f"SELECT word, doc_id, (pos - 1)::INTEGER AS pos FROM (SELECT token AS word, arg_min(doc_id, (doc_id, pos)) AS doc_id, arg_min(pos, (doc_id, pos)) AS pos FROM (SELECT doc_id, generate_subscripts(ps, 1) AS pos, unnest(ps) AS token FROM (SELECT doc_id, {PIECES_SQL} AS ps FROM documents)) WHERE token NOT IN (SELECT token FROM {VOCAB}) GROUP BY token) ORDER BY doc_id, pos LIMIT 20")
def unknown_words(read: Read) -> DataFrame:
    placed = read("documents").select("doc_id", F.posexplode(A.pieces(F.col("text"))).alias("pos", "word"))
    unknown = placed.join(vocabulary(read).withColumnRenamed("token", "word"), "word", "left_anti")
    first = unknown.groupBy("word").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    return first.orderBy("first").limit(20).select("word", "first.*")


@query(f"SELECT avg(length(token)) AS chars_per_token FROM {VOCAB}")
def vocabulary_chars(read: Read) -> DataFrame:
    return B.chars_per_token(vocabulary(read).withColumn("id", F.lit(9)))


@query(f"SELECT doc_id, substr(text, 1, 80) AS beginning, array_to_string(tokens, '|') AS tokens, len(tokens)::INTEGER AS n_tokens FROM {TOKENS} JOIN documents USING (doc_id) ORDER BY doc_id LIMIT 5")
def tokenization_examples(read: Read) -> DataFrame:
    return A.token_examples(tokenized(read).join(read("documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", "tokens")


@query("WITH r AS (SELECT n_name AS name, n_nationkey AS size, ((n_nationkey * 7) % 25 + 10)::DOUBLE AS score FROM nation) SELECT size, score, size = (SELECT min(size) FROM r WHERE score <= (SELECT min(score) FROM r) * 1.2) AS chosen FROM r")
def vocabulary_sweep(read: Read) -> DataFrame:
    reports = read("nation").select(F.col("n_nationkey").alias("size"), ((F.col("n_nationkey") * 7) % 25 + 10).cast("double").alias("score"))
    return B.best_vocabulary(reports, "size", "score", 0.2)


_HOPS = f"(SELECT {CATEGORY_SQL} AS category, doc_id % 3 AS hop FROM documents)"


@query(f"SELECT dimension, value, n, n * 100.0 / sum(n) OVER (PARTITION BY dimension) AS share_pct FROM (SELECT 'all' AS dimension, 'all' AS value, count(*) AS n FROM {_HOPS} UNION ALL SELECT 'category', category, count(*) FROM {_HOPS} GROUP BY category UNION ALL SELECT 'hop', hop::VARCHAR, count(*) FROM {_HOPS} GROUP BY hop)")
def dataset_stats(read: Read) -> DataFrame:
    return A.dataset_stats(read("documents").select(category().alias("category"), (F.col("doc_id") % 3).alias("hop")), "category", "hop")


@query(r"SELECT sum(length(text))::BIGINT AS chars_before, sum(length(regexp_replace(text, '[0-9]+', '', 'g')))::BIGINT AS chars_after, sum(length(regexp_replace(text, '[0-9]+', '', 'g'))) * 100.0 / sum(length(text)) AS retained_pct FROM documents")
def retained_share(read: Read) -> DataFrame:
    return read("documents").agg(*A.retained(F.col("text"), F.regexp_replace("text", "[0-9]+", "")))


@query("SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS mean FROM events GROUP BY event_type")
def weighted_means(read: Read) -> DataFrame:
    return read("events").groupBy("event_type").agg(F.round(A.weighted_mean(F.col("value"), F.col("user_id")), 6).alias("mean"))


_RATE = "(SELECT event_type, sum(user_id * 1000) / 1e6 AS mb, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 AS minutes FROM events GROUP BY event_type)"


@query(f"SELECT event_type, mb::DOUBLE AS mb, minutes, mb / minutes AS mb_per_min, greatest(5000.0 - mb, 0) / (mb / minutes) AS eta_min FROM {_RATE}")
def crawl_throughput(read: Read) -> DataFrame:
    log = read("events").withColumn("n_bytes", F.col("user_id") * 1000)
    return A.throughput(log, "event_type", "ts", "n_bytes", 5_000_000_000)


@query("SELECT user_id % 6 AS layer, round(avg(value), 6) AS mean, " + ", ".join(f"round(avg(CASE WHEN event_id % 4 = {h} THEN value END), 6) AS h{h}" for h in range(4)) + " FROM events GROUP BY layer")
def head_matrix(read: Read) -> DataFrame:
    heads = read("events").select((F.col("user_id") % 6).alias("layer"), (F.col("event_id") % 4).alias("head"), "value")
    return A.head_means(heads, "layer", "head", "value", 4).select("layer", *[F.round(c, 6).alias(c) for c in ("mean", "h0", "h1", "h2", "h3")])


@query("SELECT checkpoint, max(samples) AS samples, max(layer)::INTEGER AS last_layer, round(max(m), 4) AS last_mean FROM (SELECT event_type AS checkpoint, user_id % 3 AS layer, max(event_id) AS samples, avg(value) AS m FROM events GROUP BY ALL) GROUP BY checkpoint, layer HAVING layer = 2")
def checkpoint_summary(read: Read) -> DataFrame:
    values = read("events").select(F.col("event_type").alias("checkpoint"), (F.col("user_id") % 3).alias("layer"), F.col("event_id").alias("samples"), "value")
    found = A.checkpoint_summary(values, "checkpoint", "layer", "samples", "value", 3)
    own = values.where("layer = 2").groupBy("checkpoint").agg(F.max("samples").alias("samples"))
    means = F.from_json("layer_means", "array<double>")
    return found.drop("samples").join(own, "checkpoint").select("checkpoint", "samples", (F.size(means) - 1).alias("last_layer"), F.round(F.element_at(means, -1), 4).alias("last_mean"))


@query("SELECT temperature, round(avg(rate), 6) AS rate, count(*) AS n FROM (SELECT (doc_id % 4) * 0.25::DOUBLE AS temperature, CASE WHEN len(ws) < 3 THEN 0 ELSE 1 - len(list_distinct(gs)) / len(gs) END AS rate FROM (SELECT doc_id, ws, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS gs FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda ww: ww <> '') AS ws FROM documents))) GROUP BY temperature")
def metrics_by_temperature(read: Read) -> DataFrame:
    words = T.words(F.col("text"))
    grams = T.word_ngrams(words, 3)
    rate = F.when(F.size(words) < 3, 0.0).otherwise(1 - F.size(F.array_distinct(grams)) / F.size(grams))
    scored = read("documents").select(((F.col("doc_id") % 4) * 0.25).alias("temperature"), rate.alias("rate"))
    return M.by_setting(scored, "temperature", ["rate"]).select("temperature", F.round("rate", 6).alias("rate"), "n")


@query(f"SELECT doc_id, line_no::INTEGER AS line_no, value FROM {LINES} WHERE {strip_sql('value')} <> '' ORDER BY doc_id, line_no LIMIT 250")
def first_250_lines(read: Read) -> DataFrame:
    return M.first_non_blank(doc_lines(read), ["doc_id", "line_no"], "value", 250)


_EPOCH = "(SELECT doc_id, source, md5('42:1:' || source) AS s, md5('43:1:' || source || '/' || doc_id) AS p FROM documents)"


@query(f"SELECT doc_id, source, b::BIGINT AS batch_no FROM (SELECT doc_id, source, (row_number() OVER (ORDER BY s, p) - 1) // 16 AS b FROM {_EPOCH}) WHERE b >= 2 AND b < (SELECT count(*) // 16 FROM documents)")
def epoch_batches(read: Read) -> DataFrame:
    return W.epoch_order(read("documents").select("doc_id", "source"), "source", "doc_id", 1, 16, skip=2)


@query("SELECT i // 32 AS step, i % 32 AS slot, doc_id FROM (SELECT range AS i FROM range(96 * 32)) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) ON r = i % (SELECT count(*) FROM documents)")
def cyclic_batches(read: Read) -> DataFrame:
    return W.cyclic_batches(read("documents").select("doc_id"), "doc_id", 32, 96)


_STRATA = "(SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS size, dense_rank() OVER (ORDER BY lang) - 1 AS no FROM documents)"


@query(f"SELECT t.range AS turn, lang, doc_id FROM range(3000) t JOIN {_STRATA} s ON t.range % (SELECT count(DISTINCT lang) FROM documents) = s.no AND (t.range // (SELECT count(DISTINCT lang) FROM documents)) % s.size = s.r")
def round_robin(read: Read) -> DataFrame:
    return W.round_robin(read("documents").select("lang", "doc_id"), "lang", "doc_id", 3000)


@query("SELECT max(doc_id) AS step, 'ckpt_' || max(doc_id) || '.pt' AS path FROM documents")
def latest_checkpoint(read: Read) -> DataFrame:
    return W.latest_checkpoint(read("documents").select(F.concat(F.lit("ckpt_"), F.col("doc_id").cast("string"), F.lit(".pt")).alias("path")), "path")


@query("SELECT event_id, value, coalesce(value < min(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM events")
def best_of_all_events(read: Read) -> DataFrame:
    return W.best_so_far(read("events").select("event_id", "value"), "event_id", "value")


@query("WITH RECURSIVE e AS (SELECT doc_id AS dst, (doc_id - 1) // 2 AS src FROM documents WHERE doc_id > 0), b AS (SELECT 0::BIGINT AS id, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM b JOIN e ON src = id) SELECT id::VARCHAR AS url, depth FROM b")
def whole_graph(read: Read) -> DataFrame:
    """Every node of a tree of documents by breadth first: as deep as it is."""
    edges = read("documents").where("doc_id > 0").select(F.expr("(doc_id - 1) div 2").cast("string").alias("src"), F.col("doc_id").cast("string").alias("dst"))
    return H.reachable(edges, read("region").limit(1).select(F.lit("0").alias("url")))


@query("SELECT doc_id, place::BIGINT AS place, sum(n_chars) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - n_chars AS before FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY lang, doc_id) - 1 AS place FROM documents)")
def prefix_sums(read: Read) -> DataFrame:
    ordered = in_order(read("documents").select("doc_id", "lang", "n_chars"), ["lang", "doc_id"], ("n_chars",))
    return ordered.select("doc_id", F.col("row").alias("place"), F.col("n_chars_before").alias("before"))
