"""Queries of corpus and tokenizer statistics, splits, windows, logs and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import metrics as M
from corpusloom.operators import split as W
from corpusloom.operators import stats as A
from corpusloom.operators import structure as S
from corpusloom.operators import tokenizer as B
from corpusloom.plans.registry import CATEGORY_SQL, Read, category, query, quoted, words_sql
from corpusloom.plans.text_queries import CLEAN_SQL, DOC_LINES, cleaned
from corpusloom.sources.writers import rotated_texts, shard_tokens

PIECES_SQL = f"regexp_extract_all(text, {quoted(A.PIECE)})"
WORDS_N = f"len({words_sql()})"


@query(f"SELECT count(*) AS n_lines, count(*) FILTER (WHERE trim(line) = '') AS n_empty, count(*) FILTER (WHERE trim(line) LIKE 'manual%') AS n_manual, count(*) FILTER (WHERE trim(line) LIKE 'public%') AS n_public, count(*) FILTER (WHERE trim(line) <> '' AND trim(line) NOT LIKE 'manual%' AND trim(line) NOT LIKE 'public%') AS n_none FROM (SELECT {CATEGORY_SQL} || ' ' || text AS line FROM documents)")
def prefix_stats(read: Read) -> DataFrame:
    return A.prefix_counts(read("documents").select(F.concat(category(), F.lit(" "), F.col("text")).alias("line")), "line")


SOURCES = "SELECT coalesce(source, 'TOTAL') AS source, count(*) AS n_lines, sum(w)::BIGINT AS n_words, sum(w)::BIGINT / (SELECT sum({w})::BIGINT FROM {t}) AS share FROM (SELECT source, {w} AS w FROM {t}) GROUP BY ROLLUP (source)"


@query(SOURCES.format(w=WORDS_N, t="documents"))
def source_breakdown(read: Read) -> DataFrame:
    return A.source_breakdown(read("documents"), "source", "text")


@query(
    "SELECT coalesce(source, 'TOTAL') AS source, count(*) AS n_lines, sum(w)::BIGINT AS n_words, sum(w)::BIGINT / (max(t)::BIGINT) AS share FROM (SELECT source, w, sum(w) OVER () AS t FROM (SELECT source, "
    + words_sql("clean") + f" AS ws, len(ws) AS w FROM (SELECT doc_id, source, clean FROM ({CLEAN_SQL}) JOIN documents USING (doc_id) WHERE clean <> '' QUALIFY row_number() OVER (PARTITION BY clean ORDER BY doc_id) = 1))) GROUP BY ROLLUP (source)"
)
def flagship(read: Read) -> DataFrame:
    """Clean all documents, drop copies of what is left, and count texts and words by source."""
    from corpusloom.operators.dedup import first_occurrences
    from corpusloom.operators.ordering import cut

    clean = cut(cleaned(read))  # read twice below
    return A.source_breakdown(first_occurrences(clean, F.col("clean"), "doc_id"), "source", "clean")


TOKENS_SQL = f"SELECT {CATEGORY_SQL} AS category, {WORDS_N} AS w, len({PIECES_SQL}) AS t FROM documents"


@query(
    f"SELECT coalesce(category, 'total') AS category, count(*) AS n_lines, sum(w)::BIGINT AS n_words, sum(t)::BIGINT AS n_tokens, sum(t)::BIGINT / sum(w)::BIGINT AS fertility, sum(t)::BIGINT / (SELECT sum(t)::BIGINT FROM ({TOKENS_SQL})) AS token_share FROM ({TOKENS_SQL}) GROUP BY ROLLUP (category)"
)
def token_counts_by_category(read: Read) -> DataFrame:
    docs = read("documents").withColumn("category", category())
    return A.token_report(docs, "category", T.word_count(F.col("text")), A.piece_count(F.col("text")))


@query(f"SELECT source, sum(CASE WHEN lang = 'en' THEN t END)::BIGINT AS en, sum(CASE WHEN lang = 'de' THEN t END)::BIGINT AS de, sum(CASE WHEN lang = 'fr' THEN t END)::BIGINT AS fr, sum(CASE WHEN lang = 'es' THEN t END)::BIGINT AS es FROM (SELECT source, lang, len({PIECES_SQL}) AS t FROM documents) GROUP BY source")
def token_counts_pivot(read: Read) -> DataFrame:
    counted = read("documents").select("source", "lang", A.piece_count(F.col("text")).cast("bigint").alias("t"))
    return counted.groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).agg(F.sum("t"))


@query(f"SELECT lang, sum(len({PIECES_SQL}))::BIGINT / sum({WORDS_N})::BIGINT AS fertility FROM documents GROUP BY lang")
def fertility(read: Read) -> DataFrame:
    return read("documents").groupBy("lang").agg((F.sum(A.piece_count(F.col("text"))) / F.sum(T.word_count(F.col("text")))).alias("fertility"))


FREQ = f"SELECT token, count(*) AS n FROM (SELECT unnest({PIECES_SQL}) AS token FROM documents) GROUP BY token"


def frequencies(read: Read) -> DataFrame:
    return A.token_frequency(read("documents"), A.pieces(F.col("text")))


@query(FREQ)
def token_frequency(read: Read) -> DataFrame:
    return frequencies(read)


@query(
    f"SELECT count(*) AS n_unique, round(count(*) * 100.0::DOUBLE / 99996, 6) AS coverage_pct, round(avg(n), 6) AS mean_n, median(n)::DOUBLE AS median_n, round(stddev_samp(n), 4) AS stdev_n, max(n) AS max_n, min(n) AS min_n FROM ({FREQ})"
)
def token_frequency_stats(read: Read) -> DataFrame:
    stats = A.frequency_stats(frequencies(read), 100_000)
    return stats.withColumns({"coverage_pct": F.round("coverage_pct", 6), "mean_n": F.round("mean_n", 6), "stdev_n": F.round("stdev_n", 4)})


@query(f"SELECT token, n FROM ({FREQ}) ORDER BY n DESC, token LIMIT 20")
def top20_tokens(read: Read) -> DataFrame:
    return A.top(frequencies(read))


@query(f"SELECT token, n FROM ({FREQ}) ORDER BY n, token LIMIT 20")
def bottom20_tokens(read: Read) -> DataFrame:
    return A.top(frequencies(read), least=True)


@query(f"SELECT word, min(doc_id * 1000000 + pos) AS first FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {words_sql()} AS w FROM documents)) WHERE regexp_matches(word, '[%$#&*|]') GROUP BY word ORDER BY first LIMIT 20")
def oov_words(read: Read) -> DataFrame:
    """The first 20 words, in reading order, with a letter outside a vocabulary: here %, $, #, &, * or |."""
    found = A.first_words_where(read("documents"), ["doc_id"], T.words(F.col("text")), lambda w: w.rlike("[%$#&*|]"))
    return found.select("word", (F.col("doc_id") * 1000000 + F.col("pos")).alias("first"))


@query(f"SELECT avg(length(token)) AS chars_per_token FROM ({FREQ})")
def chars_per_token(read: Read) -> DataFrame:
    vocab = frequencies(read).select("token", F.lit(9).alias("id"))
    return B.chars_per_token(vocab)


VOCAB = 1500


def _bpe(read: Read) -> B.Bpe:
    return B.train_bpe(read("documents"), F.col("text"), VOCAB)


@query(None)
def bpe_vocab(read: Read) -> DataFrame:
    docs = read("documents")
    return docs.sparkSession.createDataFrame(sorted((i, t) for t, i in _bpe(read).vocab.items()), "id int, token string")


@query(None)
def bpe_encode_counts(read: Read) -> DataFrame:
    coded = B.encode(read("documents"), "doc_id", F.col("text"), _bpe(read))
    return coded.select("doc_id", F.size("ids").alias("n_tokens"))


TARGETS = {"train_manual": 50_000, "train_public": 200_000, "val": 10_000, "test": 10_000}


def _counted(read: Read) -> DataFrame:
    return read("documents").select("doc_id", category().alias("category"), A.piece_count(F.col("text")).cast("bigint").alias("n_tokens"))


QUOTA_SQL = f"""
WITH c AS (SELECT doc_id, {CATEGORY_SQL} AS category, len({PIECES_SQL})::BIGINT AS n_tokens FROM documents),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY category ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
e1 AS (SELECT min(before) AS x FROM o WHERE category = 'public' AND before >= {TARGETS['train_public']}),
e2 AS (SELECT min(before) AS x FROM o, e1 WHERE category = 'public' AND before >= e1.x + {TARGETS['val']}),
e3 AS (SELECT min(before) AS x FROM o, e2 WHERE category = 'public' AND before >= e2.x + {TARGETS['test']})
SELECT doc_id, category, n_tokens,
  CASE WHEN category = 'manual' THEN CASE WHEN before < {TARGETS['train_manual']} THEN 'train' END
       WHEN e1.x IS NULL OR before < e1.x THEN 'train' WHEN e2.x IS NULL OR before < e2.x THEN 'val' WHEN e3.x IS NULL OR before < e3.x THEN 'test' END AS split
FROM o, e1, e2, e3"""


@query(QUOTA_SQL)
def quota_split(read: Read) -> DataFrame:
    return W.quota_split(_counted(read), "category", "doc_id", "n_tokens", TARGETS)


@query(f"SELECT coalesce(split, 'none') AS split, category, count(*) AS n_docs, sum(n_tokens)::BIGINT AS n_tokens FROM ({QUOTA_SQL}) GROUP BY ALL")
def quota_split_totals(read: Read) -> DataFrame:
    done = W.quota_split(_counted(read), "category", "doc_id", "n_tokens", TARGETS)
    return done.groupBy(F.coalesce("split", F.lit("none")).alias("split"), "category").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= n // 2")
def head_half(read: Read) -> DataFrame:
    return W.head_half(read("documents").select("doc_id"), "doc_id")


@query("SELECT size::INTEGER AS size, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents), (SELECT unnest([100, 250, 500]) AS size) WHERE r <= size")
def nested_subsets(read: Read) -> DataFrame:
    return W.nested_subsets(read("documents"), "doc_id", [100, 250, 500])


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 40")
def stratified_40(read: Read) -> DataFrame:
    return W.stratified(read("documents").select("doc_id", "lang"), "lang", "doc_id", 40)


@query(f"SELECT item_id, unnest(range(0, len(w) - 8))::INTEGER AS start, array_to_string(w[start + 1:start + 8], ' ') AS x, array_to_string(w[start + 2:start + 9], ' ') AS y FROM (SELECT item_id, {words_sql()} AS w FROM benchmark) WHERE len(w) > 8")
def training_windows(read: Read) -> DataFrame:
    return _windows(read("benchmark"), "item_id")


@query(f"""SELECT doc_id, (i - 1)::INTEGER AS start, array_to_string(x, ' ') AS x, array_to_string(y, ' ') AS y
FROM (SELECT doc_id, i, n, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS x, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS y
  FROM (SELECT doc_id, len(ws) AS n, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT doc_id, {words_sql()} AS ws FROM documents))) WHERE i + 8 <= n""")
def training_windows_documents(read: Read) -> DataFrame:
    """Windows over whole documents, long ones too."""
    return _windows(read("documents"), "doc_id")


def _windows(df: DataFrame, key: str) -> DataFrame:
    cut_up = W.window_rows(df, [key], T.words(F.col("text")), 8)
    return cut_up.select(key, "start", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


@query(f"SELECT source, sum(t)::BIGINT AS n_tokens, greatest(sum(t)::BIGINT - 512, 0) AS positions, greatest(sum(t)::BIGINT - 512, 0) // 16 AS batches FROM (SELECT source, len({PIECES_SQL}) AS t FROM documents) GROUP BY source")
def positions_per_shard(read: Read) -> DataFrame:
    shards = read("documents").groupBy("source").agg(F.sum(A.piece_count(F.col("text"))).alias("n_tokens"))
    return shards.withColumn("positions", W.positions(F.col("n_tokens"), 512)).withColumn("batches", F.floor(F.col("positions") / 16))


def fold_sql(rows: str, limit: int, every: int, out: str) -> str:
    """(doc_id, out) from rows (doc_id, n): batches of `every` rows, a new index once a sum of batches reaches the limit."""
    return f"""
WITH RECURSIVE r AS (SELECT doc_id, n, (row_number() OVER (ORDER BY doc_id) - 1) // {every} AS b FROM ({rows})),
t AS MATERIALIZED (SELECT b, sum(n)::BIGINT AS n, count(*) AS c FROM r GROUP BY b),
f(b, idx, acc) AS (
  SELECT b, 0, CASE WHEN n >= {limit} AND c = {every} THEN -1 ELSE n END FROM t WHERE b = 0
  UNION ALL
  SELECT t.b, f.idx + CASE WHEN f.acc = -1 THEN 1 ELSE 0 END, CASE WHEN greatest(f.acc, 0) + t.n >= {limit} AND t.c = {every} THEN -1 ELSE greatest(f.acc, 0) + t.n END
  FROM f JOIN t ON t.b = f.b + 1)
SELECT doc_id, idx::INTEGER AS {out} FROM r JOIN f USING (b)"""


@query(fold_sql(f"SELECT doc_id, len({PIECES_SQL}) AS n FROM documents", 60_000, 50, "shard_idx"))
def shard_assignment(read: Read) -> DataFrame:
    counted = read("documents").select("doc_id", A.piece_count(F.col("text")).cast("bigint").alias("n_tokens"))
    return shard_tokens(counted, "doc_id", "n_tokens", 60_000, 50).select("doc_id", "shard_idx")


@query(fold_sql("SELECT doc_id, strlen(text) + 2 AS n FROM documents", 200_000, 1, "file_index"))
def file_rotation(read: Read) -> DataFrame:
    return rotated_texts(read("documents").select("doc_id", "text"), "doc_id", "text", 200_000).select("doc_id", "file_index")


RUNS = "SELECT source, avg(n_chars) AS a, stddev_pop(n_chars) AS b FROM documents GROUP BY source"


@query(f"""SELECT source, score, source = arg_min(source, (score, source)) OVER () AS selected FROM (SELECT source, round(0.6 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + 0.4 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 6) AS score
  FROM (SELECT source, (sum(n_chars) // 100)::DOUBLE AS a, max(n_chars)::DOUBLE AS b FROM documents GROUP BY source))""")
def minmax_model_selection(read: Read) -> DataFrame:
    """Sources as models, total and greatest length as their two metrics."""
    runs = read("documents").groupBy("source").agg(F.expr("sum(n_chars) div 100").cast("double").alias("a"), F.max("n_chars").cast("double").alias("b"))
    return W.select_model(runs, "source", {"a": 0.6, "b": 0.4}).select("source", "score", "selected")


@query("SELECT event_id, value, value < coalesce(min(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS is_best FROM events WHERE event_type = 'error'")
def best_so_far(read: Read) -> DataFrame:
    return W.best_so_far(read("events").where("event_type = 'error'").select("event_id", "value"), "event_id", "value")


@query("SELECT event_id // 100 AS interval_no, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def interval_means(read: Read) -> DataFrame:
    return A.interval_means(read("events"), "event_id", 100, "value").withColumn("mean_value", F.round("mean_value", 6))


@query("SELECT event_id, round(CASE WHEN event_id < 200 THEN event_id * 0.001 / 200 WHEN event_id >= 5000 THEN 0.0001 ELSE 0.0001 + 0.5 * (1 + cos(pi() * (event_id - 200) / 4800)) * 0.0009 END, 9) AS lr FROM events")
def lr_schedule(read: Read) -> DataFrame:
    return read("events").select("event_id", F.round(W.learning_rate(F.col("event_id"), 200, 5000, 0.001, 0.0001), 9).alias("lr"))


#: A user's turn and the assistant's after it, as reference and hypothesis.
PAIRS = "SELECT u.conv_id * 1000 + u.turn AS id, u.text AS ref, a.text AS hyp FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"


def pairs(read: Read) -> DataFrame:
    c = read("conversations")
    users = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return users.join(answers, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "ref", "hyp")


def grams_sql(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))"


GRAMS3 = f"SELECT id, g, count(*) AS n FROM (SELECT id, unnest({grams_sql('w', 3)}) AS g FROM (SELECT id, {words_sql('hyp')} AS w FROM ({PAIRS})) WHERE len(w) >= 3) GROUP BY ALL"


@query(f"SELECT sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT / sum(n)::BIGINT AS repetition_rate FROM ({GRAMS3})")
def repetition_rate_3(read: Read) -> DataFrame:
    return M.repetition_rate(pairs(read), "id", F.col("hyp"))


def distinct_sql(n: int) -> str:
    return f"(SELECT count(DISTINCT g) / count(*) FROM (SELECT unnest({grams_sql('w', n)}) AS g FROM (SELECT {words_sql('hyp')} AS w FROM ({PAIRS})) WHERE len(w) >= {n}))"


@query(f"SELECT {distinct_sql(1)} AS distinct_1, {distinct_sql(2)} AS distinct_2")
def distinct_1_2(read: Read) -> DataFrame:
    p = pairs(read)
    return M.distinct_n(p, F.col("hyp"), 1).join(M.distinct_n(p, F.col("hyp"), 2))


def overlap_sql(hyp: str, ref: str, n: int) -> str:
    """(n_hyp, n_ref, n_match) of the gram lists hyp and ref of pairs."""
    side = lambda g: f"SELECT id, g, count(*) AS c FROM (SELECT id, unnest({g}) AS g FROM p) GROUP BY ALL"
    return f"SELECT {n} AS o, coalesce(sum(h.c), 0)::DOUBLE AS n_hyp, coalesce(sum(r.c), 0)::DOUBLE AS n_ref, coalesce(sum(least(coalesce(h.c, 0), coalesce(r.c, 0))), 0)::DOUBLE AS n_match FROM ({side(hyp)}) h FULL JOIN ({side(ref)}) r USING (id, g)"


WORD_PAIRS = f"p AS MATERIALIZED (SELECT id, {words_sql('hyp')} AS h, {words_sql('ref')} AS r FROM ({PAIRS}))"


def word_grams_sql(w: str, n: int) -> str:
    return f"CASE WHEN len({w}) >= {n} THEN {grams_sql(w, n)} ELSE [] END"


@query(
    f"WITH {WORD_PAIRS}, o AS MATERIALIZED (" + " UNION ALL ".join(overlap_sql(word_grams_sql("h", n), word_grams_sql("r", n), n) for n in range(1, 5))
    + "), z AS (SELECT *, sum(CASE WHEN n_match = 0 THEN 1 ELSE 0 END) OVER (ORDER BY o) AS k FROM o)"
    " SELECT round((SELECT CASE WHEN n_hyp >= n_ref THEN 1.0 ELSE exp(1 - n_ref / n_hyp) END FROM o WHERE o = 1) * exp(avg(ln(CASE WHEN n_match = 0 THEN 100.0 / pow(2, k) / n_hyp ELSE 100.0 * n_match / n_hyp END))), 6) AS bleu FROM z"
)
def bleu4(read: Read) -> DataFrame:
    return M.bleu(pairs(read), "id", "hyp", "ref").select(F.round("bleu", 6).alias("bleu"))


CHAR_PAIRS = rf"p AS MATERIALIZED (SELECT id, regexp_replace(hyp, '\s+', '', 'g') AS h, regexp_replace(ref, '\s+', '', 'g') AS r, hyp, ref FROM ({PAIRS}))"


def char_grams_sql(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) >= {n} THEN list_transform(range(1, length({c}) - {n - 2}), lambda i: {c}[i:i + {n - 1}]) ELSE [] END"


CHRF_END = " SELECT round(100.0 * 5 * p * r / (4 * p + r), 6) AS chrf FROM (SELECT avg(n_match / n_hyp) AS p, avg(n_match / n_ref) AS r FROM o WHERE n_hyp > 0 AND n_ref > 0)"


@query(f"WITH {CHAR_PAIRS}, o AS (" + " UNION ALL ".join(overlap_sql(char_grams_sql("h", n), char_grams_sql("r", n), n) for n in range(1, 7)) + ")" + CHRF_END)
def chrf(read: Read) -> DataFrame:
    return M.chrf(pairs(read), "id", "hyp", "ref").select(F.round("chrf", 6).alias("chrf"))


def _spaced_sql(c: str) -> str:
    """Punctuation at a word's ends set off by spaces; what RE2 can't look ahead to is put back."""
    before = rf"regexp_replace({c}, '([^\p{{L}}\p{{N}}\s])(\s|$)', ' \1\2', 'g')"
    return rf"regexp_replace({before}, '(^|\s)([^\p{{L}}\p{{N}}\s])', '\1\2 ', 'g')"


SPACED_PAIRS = CHAR_PAIRS[:-1] + f"), q AS MATERIALIZED (SELECT id, {words_sql(_spaced_sql('hyp'))} AS h, {words_sql(_spaced_sql('ref'))} AS r FROM p)"
_PLUS = [overlap_sql(char_grams_sql("h", n), char_grams_sql("r", n), n) for n in range(1, 7)] + [
    overlap_sql(word_grams_sql("h", n), word_grams_sql("r", n), 6 + n).replace("FROM p)", "FROM q)") for n in (1, 2)
]


@query(f"WITH {SPACED_PAIRS}, o AS (" + " UNION ALL ".join(_PLUS) + ")" + CHRF_END)
def chrfpp(read: Read) -> DataFrame:
    return M.chrf(pairs(read), "id", "hyp", "ref", word_order=2).select(F.round("chrf", 6).alias("chrf"))


#: The table's rows one after another: a row is the running maximum of what is above, and above to the left with a match.
LCS_SQL = "list_reduce(list_prepend(list_transform(r, lambda y: 0), list_transform(h, lambda x: list_transform(r, lambda y: (x = y)::INTEGER))), lambda row, eq: list_transform(range(1, len(row) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(row[k], CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END + eq[k])))::INTEGER))[-1]"


@query(
    f"WITH {WORD_PAIRS}, l AS (SELECT len(h) AS nh, len(r) AS nr, CASE WHEN len(h) = 0 OR len(r) = 0 THEN 0 ELSE {LCS_SQL} END AS l FROM p),"
    " s AS (SELECT CASE WHEN nh > 0 THEN l / nh ELSE 0 END AS p, CASE WHEN nr > 0 THEN l / nr ELSE 0 END AS r FROM l)"
    " SELECT round(100 * avg(p), 6) AS rouge_l_p, round(100 * avg(r), 6) AS rouge_l_r, round(100 * avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS rouge_l_f FROM s"
)
def rouge_l(read: Read) -> DataFrame:
    found = M.rouge_l(pairs(read), "hyp", "ref")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


#: Labelled documents as predictions: correct if of good quality, by language and by hops, the length class.
PREDICTIONS = "SELECT d.doc_id, lang AS category, (n_chars % 4 + 1)::INTEGER AS hop, quality = 1 AS correct, toxic = 0 AS before FROM documents d JOIN labels l USING (doc_id)"


def predictions(read: Read) -> DataFrame:
    joined = read("documents").join(read("labels"), "doc_id")
    return joined.select("doc_id", F.col("lang").alias("category"), (F.col("n_chars") % 4 + 1).cast("int").alias("hop"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 0).alias("before"))


ACCURACY = "count(*) FILTER (WHERE correct) AS n_correct, count(*) AS n_total, count(*) FILTER (WHERE correct) * 100.0::DOUBLE / count(*) AS accuracy_pct"


@query(f"WITH p AS ({PREDICTIONS}) SELECT 'all' AS dimension, 'all' AS value, {ACCURACY} FROM p UNION ALL SELECT 'category', category, {ACCURACY} FROM p GROUP BY category UNION ALL SELECT 'hop', hop::VARCHAR, {ACCURACY} FROM p GROUP BY hop")
def exact_match_by_group(read: Read) -> DataFrame:
    return A.accuracy(predictions(read), ["category", "hop"], F.col("correct"))


@query(f"SELECT CASE WHEN hop = 1 THEN 'one' ELSE 'several' END AS hops, {ACCURACY} FROM ({PREDICTIONS}) GROUP BY 1")
def hop_rollup(read: Read) -> DataFrame:
    p = predictions(read).withColumn("hops", F.when(F.col("hop") == 1, "one").otherwise("several"))
    return A.accuracy(p, ["hops"], F.col("correct")).where("dimension = 'hops'").select(F.col("value").alias("hops"), "n_correct", "n_total", "accuracy_pct")


@query(f"SELECT * FROM (SELECT doc_id, category, 'fixed' AS kind FROM ({PREDICTIONS}) WHERE correct AND NOT before ORDER BY doc_id LIMIT 8) UNION ALL SELECT * FROM (SELECT doc_id, category, 'failed' FROM ({PREDICTIONS}) WHERE NOT correct ORDER BY doc_id LIMIT 8)")
def pred_join_fixed(read: Read) -> DataFrame:
    """The first eight that became right, and the first eight that are wrong."""
    p = predictions(read)
    first = lambda test, kind: p.where(test).orderBy("doc_id").limit(8).select("doc_id", "category", F.lit(kind).alias("kind"))
    return first("correct AND NOT before", "fixed").unionByName(first("NOT correct", "failed"))


@query("SELECT event_type, round(ce, 6) AS ce, round(exp(least(ce, 20)), 3) AS ppl, round(ce / ln(2) / (b / t), 6) AS bpb FROM (SELECT event_type, sum(value / 20) / count(*) AS ce, sum(strlen(props)) AS b, count(*) AS t FROM events GROUP BY event_type)")
def perplexity_bpb(read: Read) -> DataFrame:
    ce, ppl, bpb = A.perplexity(F.col("value") / 20, F.lit(1), F.octet_length("props"))
    rows = read("events").groupBy("event_type").agg(ce, ppl, bpb)
    return rows.select("event_type", F.round("ce", 6).alias("ce"), F.round("ppl", 3).alias("ppl"), F.round("bpb", 6).alias("bpb"))


@query("SELECT event_type, round(sum(value) / ln(2) / 1000000, 6) AS bpb_file_bytes FROM events GROUP BY event_type")
def bpb_file_bytes(read: Read) -> DataFrame:
    rows = read("events").groupBy("event_type").agg(A.file_bytes_bpb(F.col("value"), F.lit(1_000_000)))
    return rows.select("event_type", F.round("bpb_file_bytes", 6).alias("bpb_file_bytes"))


#: Embeddings as rows of attention: exponentials over their sum, in thousandths.
SOFTMAX_SQL = "list_transform(list_transform(embedding, lambda x: exp(x::DOUBLE)), lambda e: e / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))))"


def softmax(c: Column) -> Column:
    return T.let(F.transform(c, lambda x: F.exp(x.cast("double"))), lambda e: T.let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(e, lambda x: x / s)))


@query(f"SELECT vec_id, round(list_sum(list_transform(w, lambda x: -greatest(x, 1e-9) * log2(greatest(x, 1e-9)))), 6) AS entropy FROM (SELECT vec_id, {SOFTMAX_SQL} AS w FROM embeddings)")
def attention_entropy(read: Read) -> DataFrame:
    return read("embeddings").select("vec_id", F.round(A.attention_entropy(softmax(F.col("embedding"))), 6).alias("entropy"))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, len(w) + 1), lambda i: w[i] * abs(63 - (i - 1)))), 6) AS distance FROM (SELECT vec_id, {SOFTMAX_SQL} AS w FROM embeddings)")
def attention_distance(read: Read) -> DataFrame:
    return read("embeddings").select("vec_id", F.round(A.attention_distance(softmax(F.col("embedding")), F.lit(63)), 6).alias("distance"))


MARGIN = "SELECT lang, source, n_chars FROM documents"


@query(
    "SELECT lang, source, grouping_id(lang, source)::BIGINT AS grouping, count(*) AS n, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, quantile_cont(n_chars, 0.25)::DOUBLE AS q1, quantile_cont(n_chars, 0.5)::DOUBLE AS q2, quantile_cont(n_chars, 0.75)::DOUBLE AS q3 FROM documents GROUP BY CUBE (lang, source)"
)
def sweep_marginals(read: Read) -> DataFrame:
    return A.marginals(read("documents").select("lang", "source", "n_chars"), ["lang", "source"], "n_chars").withColumn("mean", F.round("mean", 6))


@query("SELECT source, rank FROM (SELECT source, row_number() OVER (ORDER BY sum(n_chars), source) AS rank FROM documents GROUP BY source) WHERE rank <= 5")
def sweep_top5(read: Read) -> DataFrame:
    runs = read("documents").groupBy("source").agg(F.sum("n_chars").alias("loss"))
    return A.rank_runs(runs, "loss", "source").where("rank <= 5").select("source", "rank")


@query("SELECT component, round(avg(norm), 6) AS mean_norm, count(*) AS n_tensors FROM (SELECT 'layer' || (label % 4) AS component, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings) GROUP BY component")
def weight_norms(read: Read) -> DataFrame:
    name = F.concat(F.lit("layer"), (F.col("label") % 4).cast("string"), F.lit("."), F.col("vec_id").cast("string"))
    values = read("embeddings").select(name.alias("name"), F.explode("embedding").alias("v")).select("name", F.col("v").cast("double").alias("v"))
    return A.weight_norms(values, "name", "v").withColumn("mean_norm", F.round("mean_norm", 6))


@query(
    "WITH s AS (SELECT lang, source, avg(n_chars) AS v FROM documents WHERE lang IN ('en', 'de') GROUP BY ALL) SELECT source, round(a.v, 6) AS before, round(b.v, 6) AS after, round(b.v - a.v, 6) AS delta, round((b.v - a.v) * 100 / a.v, 6) AS change_pct FROM s a JOIN s b USING (source) WHERE a.lang = 'en' AND b.lang = 'de'"
)
def checkpoint_deltas(read: Read) -> DataFrame:
    means = lambda lang: read("documents").where(F.col("lang") == lang).groupBy("source").agg(F.avg("n_chars").alias("v"))
    both = A.compare_checkpoints(means("en"), means("de"), "source", "v")
    return both.select("source", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta", "change_pct")])


@query("SELECT doc_id, coalesce(l.quality::DOUBLE, d.n_chars::DOUBLE) AS loss, CASE WHEN l.quality IS NOT NULL THEN 'saved' ELSE 'computed' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)")
def checkpoint_losses(read: Read) -> DataFrame:
    saved = read("labels").select("doc_id", F.col("quality").cast("double").alias("loss"))
    return A.saved_or_computed(saved, read("documents").select("doc_id", F.col("n_chars").cast("double").alias("loss")), "doc_id", "loss")


@query("SELECT p_partkey, (7500 + p_partkey) * 512 AS embedding, (7500 + p_partkey) * 512 + 6 * (4 * 512 * 512 + 4 * 512 + 2 * 512 * 1600 + 1600 + 512 + 512 * 1600 + 1600) + 2 * 512 AS total FROM part")
def parameter_counts(read: Read) -> DataFrame:
    """Models of vocabularies of 7,500 and more: parts stand for configurations."""
    n = A.parameter_count(7500 + F.col("p_partkey"), F.lit(512), F.lit(6), F.lit(1600), F.lit(True), F.lit(True))
    return read("part").select("p_partkey", n.alias("n")).select("p_partkey", "n.embedding", "n.total")


@query("SELECT event_type, sum(CASE WHEN user_id % 100 >= 50 THEN value END) / count(*) FILTER (WHERE user_id % 100 >= 50) > 0 AS positive, count(*) FILTER (WHERE user_id % 100 >= 50) AS n_tokens FROM events GROUP BY event_type")
def masked_nll(read: Read) -> DataFrame:
    loss, n = B.masked_loss(F.col("value"), F.col("user_id") % 100, F.lit(50))
    return read("events").groupBy("event_type").agg(loss, n).select("event_type", (F.col("loss") / F.col("n_tokens") > 0).alias("positive"), "n_tokens")


@query("SELECT doc_id, line_no::INTEGER AS line_no FROM (" + DOC_LINES + ") WHERE line_no = 0")
def first_lines(read: Read) -> DataFrame:
    return S.split_lines(read("documents"), "doc_id", "text").where("line_no = 0").select("doc_id", "line_no")


