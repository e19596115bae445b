"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordforge.llm import ball_tree, chosen_path, impact_search, language, latent_decontam, line_templates, lm_scoring, mixing, quality, shared_spans, toxicity, url_rules, word_runs
from recordforge.llm.labelled import labelled_rows, training_rows
from recordforge.llm.textarrays import held_out
from recordforge.sources.tables import load

#: Labelled rows that a classifier learns from, at the most.
TRAIN_ROWS = 20_000
#: The same for the embeddings, whose features take more memory.
QUALITY_TRAIN_ROWS = 8_000
#: The rules of the URL query: action, host, path.
HOST_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words that mark a host, or a folder of it, as unwanted, whatever else the table holds.
KEYWORDS = (
    # gambling
    "bet", "bets", "betting", "bingo", "casino", "casinos", "gambling", "jackpot", "lottery", "poker", "roulette", "slots", "wager",
    # pharmacy
    "cialis", "pharmacy", "pills", "steroids", "tramadol", "viagra", "xanax",
    # adult
    "adult", "escort", "escorts", "nude", "porn", "sex", "webcam", "xxx",
    # advertising and tracking
    "ad", "ads", "adserver", "adservice", "banner", "banners", "clicktrack", "popunder", "popup", "tracker", "tracking",
    # spam and fraud
    "crack", "keygen", "linkfarm", "malware", "payday", "phishing", "spam", "torrent", "torrents", "warez",
)
#: Target shares of tokens, by language and by quality label.
LANGUAGE_SHARES = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}
QUALITY_SHARES = {0: 0.05, 1: 0.95}
MIX_TARGETS = {f"{lang}/{quality}": a * b for lang, a in LANGUAGE_SHARES.items() for quality, b in QUALITY_SHARES.items()}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(training_rows(docs, load(spark, sf_dir, "labels"), "toxic", 4, 2, TRAIN_ROWS), "text", "label")
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), parsed AS (
  SELECT doc_id, text, pos, line, string_split_regex(regexp_replace(trim(line), '[0-9]+', '<*>', 'g'), '\s+') AS tok FROM lines WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')
), counted AS (
  SELECT *, len(tok) AS n, CAST(ceil((len(tok) - 3) / 4.0) AS INTEGER) AS w FROM parsed
), templates AS (
  SELECT doc_id, text, pos, n, s, tok[1:3 + w * s] AS head, tok[4 + w * (s + 1):n] AS tail FROM counted, (SELECT unnest([0, 1, 2, 3]) AS s) WHERE n >= 8
  UNION ALL
  SELECT doc_id, text, pos, n, -1, tok, [] FROM counted WHERE n >= 5 AND n < 8
  UNION ALL
  SELECT doc_id, text, pos, n, -2, [trim(line)], [] FROM counted WHERE n < 5
), firsts AS (
  SELECT n, s, head, tail, min(doc_id) AS first_doc FROM templates GROUP BY ALL HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, text, pos FROM templates JOIN firsts USING (n, s, head, tail) WHERE doc_id > first_doc
), kept AS (
  SELECT l.doc_id, l.text, count(*) FILTER (g.pos IS NULL) AS n_kept, count(*) FILTER (g.pos IS NOT NULL) AS n_gone,
         string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS rest
  FROM (SELECT DISTINCT * FROM lines) l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.text = g.text AND l.pos = g.pos GROUP BY l.doc_id, l.text
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS INTEGER) AS n_lines,
       CAST(coalesce(k.n_gone, 0) AS INTEGER) AS n_dropped, CASE WHEN coalesce(k.n_gone, 0) = 0 THEN d.text ELSE coalesce(k.rest, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""


def mix_by_labels(spark: SparkSession, docs: DataFrame, sf_dir: str, keep_text: bool = False) -> DataFrame:
    """Domains are language and quality label; the labels teach the classifier."""
    label = F.when(F.col("quality").isin(*QUALITY_SHARES), F.col("quality"))
    rows = labelled_rows(docs, load(spark, sf_dir, "labels"), label, TRAIN_ROWS, extra=("lang",))
    domain = F.when(F.col("lang").isin(*LANGUAGE_SHARES), F.concat_ws("/", "lang", "label"))
    return mixing.mix(docs, rows.withColumn("domain", domain), MIX_TARGETS, keep_text=keep_text)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_by_labels(spark, load(spark, sf_dir, "documents").select("doc_id", "text", "lang"), sf_dir)
    return mixed.select("doc_id", "n_tokens", "domain", F.round(F.array_max("posterior"), 6).alias("confidence"), "rate", "copies")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_rules.host_rules(spark.createDataFrame(HOST_RULES, "action string, host string, path string"))
    words = spark.createDataFrame([("block", w) for w in KEYWORDS], "action string, word string")
    return url_rules.judge(pages, rules.unionByName(url_rules.keyword_rules(words))).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in HOST_RULES)
OP4_SQL = rf"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{url_rules.UPPER}', '{url_rules.LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), marks AS (
  SELECT DISTINCT host, path, list_concat(list_slice(string_split_regex(host, '[.-]'), 1, -2), list_slice(string_split(translate(path, '{url_rules.UPPER}', '{url_rules.LOWER}'), '/'), 2, -1)) AS ws FROM parts
), bad AS (
  SELECT host, path FROM marks WHERE list_has_any(ws, [{", ".join(f"'{w}'" for w in KEYWORDS)}])
), rules(action, rule_host, rule_path) AS (VALUES {_RULE_ROWS}),
fits AS (
  SELECT DISTINCT host, path, action, rule_host || rule_path AS rule FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM fits GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule, coalesce(action, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path LEFT JOIN bad ON p.host = bad.host AND p.path = bad.path
"""


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(training_rows(docs, load(spark, sf_dir, "labels"), "quality", 4, 2, QUALITY_TRAIN_ROWS), "text", "label")
    return quality.score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(load(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out("doc_id", 7, 2))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~held_out("doc_id", 3, 1)), "text", "lang")
    return language.predict(docs.drop("lang"), model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = latent_decontam.flag(docs, load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).cast("int").alias("contaminated"), "items", "overlap")


#: The six ASCII blanks between words, and a word.
BLANKS, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def periodic(docs: DataFrame) -> DataFrame:
    """The documents, of which every tenth repeats a stretch of its words to its end; ids decide where and how."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = docs.select("doc_id", "text", crc.alias("h"), F.when(crc % 10 == 0, F.filter(F.split("text", BLANKS), lambda w: w != "")).alias("w"))
    cut = cut.select("doc_id", "text", "w", F.size("w").cast("long").alias("n"), F.floor(F.col("h") / 10).alias("g")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    as_int = lambda x: x.cast("int")
    period = F.slice("w", as_int(F.col("a") + 1), as_int(F.col("p")))
    tail = F.slice(F.flatten(F.array_repeat(period, as_int(F.ceil((F.col("n") - F.col("a")) / F.col("p"))))), 1, as_int(F.col("n") - F.col("a")))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", 1, as_int(F.col("a"))), tail), " ")).otherwise(F.col("text")).alias("text"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.collapse_runs(periodic(load(spark, sf_dir, "documents")))
    # By start and period already: only a greater exponent takes the place of an earlier run.
    most = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"), F.coalesce("collapsed", F.lit("")).alias("collapsed"))
    return found.select("doc_id", "n_runs", "most.start", "most.length", "most.period", F.floor(1000 * F.col("most.length") / F.col("most.period")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _op11_sql(most_words: int = 1 << 17) -> str:
    """Units of 2, 4, 8 .. words; the next equal unit tells the period, as within a run they are equal at its multiples only."""
    steps, unions, k = [], [], 2
    while k <= most_words // 2:
        half = "w AS half, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS other FROM words" if k == 2 else f"name AS half, lead(name, {k // 2}) OVER (PARTITION BY doc_id ORDER BY i) AS other FROM unit{k // 2}"
        steps.append(f"unit{k} AS MATERIALIZED (SELECT doc_id, i, CASE WHEN half IS NOT NULL AND other IS NOT NULL THEN dense_rank() OVER (ORDER BY doc_id, half, other) END AS name FROM (SELECT doc_id, i, {half}) WHERE {k // 2} <= (SELECT max(i) + 1 FROM words))")
        unions.append(f"SELECT doc_id, i, {k} AS k, lead(i) OVER (PARTITION BY name ORDER BY i) - i AS q FROM unit{k} WHERE name IS NOT NULL")
        k *= 2
    return ",\n".join(steps) + ",\nnear AS (" + "\nUNION ALL ".join(unions) + ")"


OP11_SQL = rf"""
WITH crc AS (
  SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda u, v: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384::BIGINT) ELSE u >> 1 END)), 4294967295::BIGINT) AS h FROM documents
), cut AS (
  SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM crc
), shape AS (
  SELECT *, len(ws) AS n, g % nullif(len(ws), 0) AS a FROM cut
), source AS (
  SELECT doc_id, ws, n, unnest(range(n)) AS i, CASE WHEN h % 10 = 0 THEN a ELSE n END AS a, 1 + (n - a) // (3 + g % 8) AS p FROM shape
), words AS MATERIALIZED (
  SELECT doc_id, i, CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END AS w FROM source
),
{_op11_sql()},
runs AS MATERIALIZED (
  SELECT doc_id, min(i) AS start, max(i) - min(i) + q + any_value(k) AS length, q AS period
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, k, q ORDER BY i) AS island FROM near WHERE q >= k // 2 AND q < k)
  GROUP BY doc_id, q, island HAVING length >= greatest(6, 4 * q)
), best AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, [-length::DOUBLE / period, start, period]) AS m,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, m.start AS start, m.length AS length, m.period AS period, 1000 * m.length // m.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op12_shared_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shared_spans.drop_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {shared_spans.WINDOW - 1}], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - {shared_spans.WINDOW - 2})) AS i FROM d)
), firsts AS (
  SELECT k, min(doc_id) AS f FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM windows JOIN firsts USING (k), (SELECT unnest(range({shared_spans.WINDOW})) AS j) WHERE doc_id > f
), words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.search(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("item_id", "text"))


OP13_SQL = rf"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{url_rules.UPPER}', '{url_rules.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), item_terms AS (
  SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{url_rules.UPPER}', '{url_rules.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL
), tf AS (
  SELECT doc_id, t, count(*) AS tf FROM doc_terms GROUP BY ALL
), lengths AS (
  SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), norms AS (
  SELECT doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM lengths, corpus
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY t, n_docs
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM item_terms JOIN weights USING (t) JOIN tf USING (t) JOIN norms USING (doc_id) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= {impact_search.TOP}
"""


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_line_templates, op3_mix, op4_url_rules, op5_jaccard_join, op6_ball_tree, op7_quality, op8_lm_score, op9_language, op10_decontaminate, op11_word_runs, op12_shared_spans, op13_impact_search)}
ORACLE_SQL = {"op2_line_templates": OP2_SQL, "op4_url_rules": OP4_SQL, "op6_ball_tree": OP6_SQL, "op11_word_runs": OP11_SQL, "op12_shared_spans": OP12_SQL, "op13_impact_search": OP13_SQL}
