"""The queries of this package, over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import shared


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.token_index import read_tokens, write_tokens

    out = shared.shared_path(spark, "tokens")
    shared.passing(spark, out)
    shards = write_tokens(_table(spark, sf_dir, "documents"), out, tokenizer_path("word_bpe_49k.json"))
    return read_tokens(spark, out, shards)


def op2_html_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.html_style_tree import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op3_sp_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.sp_wfst import digests, encode_decode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, tokenizer_path("piece_bpe_32k.model")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.pu_quality import scores

    return scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.chat_format import digests, format_conversations

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(format_conversations(turns.unionByName(probe)))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch day for each: a day of 2024 that follows from the page's id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts of the pages, by the digits of each host's MD5.

    Two lists take some hosts up on a day of the year and drop some of them later; one takes whole domains, and one the
    first directory of some hosts.
    """
    from driftline.llm.url_filters import host, segments

    paths = pages.select(host(F.col("url")).alias("value"), F.get(segments(F.col("url")), F.lit(0)).alias("first")).distinct().where("value != ''")
    paths = shared.written(paths, "hosts")
    hosts = shared.written(paths.select("value").distinct(), "hosts")
    digit = lambda at, n=1: F.conv(F.substring(F.md5("value"), at, n), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    spam = hosts.where(digit(1) < 6)
    on, off, again = digit(2, 2), digit(2, 2) + 30 + digit(4), digit(2, 2) + 60 + digit(5, 2)
    entry = lambda df, name, action, when: df.select(F.lit(name).alias("list_name"), "value", F.lit(action).alias("action"), day(when).alias("day"))
    out = entry(spam, "spam", "add", on).unionByName(entry(spam.where(digit(7) < 10), "spam", "remove", off)).unionByName(entry(spam.where(digit(8) < 5), "spam", "add", again))
    out = out.unionByName(entry(hosts.where(digit(9) < 3), "adult", "add", digit(10, 2)))
    parents = hosts.where(F.col("value").like("%.%.%.%")).select(F.expr("substring(value, instr(value, '.') + 1)").alias("value")).distinct()
    below = paths.where("first IS NOT NULL").select(F.concat_ws("/", "value", "first").alias("value"))
    return out.unionByName(entry(parents.where(digit(1) < 4), "domains", "add", digit(2, 2))).unionByName(entry(below.where(digit(1) < 5), "paths", "add", digit(2, 2)))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.url_filters import evaluate

    pages = _table(spark, sf_dir, "pages")
    return evaluate(captures(pages), dated_lists(pages)).select("page_id", "blocked", "n_lists", "lists")


def op9_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.simhash_anchor import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_topk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.topk_segments import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_index": op1_token_index,
    "op2_html_style_tree": op2_html_style_tree,
    "op3_sp_wfst": op3_sp_wfst,
    "op4_token_counts": op4_token_counts,
    "op5_pu_quality": op5_pu_quality,
    "op6_chat_format": op6_chat_format,
    "op7_decontaminate": op7_decontaminate,
    "op8_url_filters": op8_url_filters,
    "op9_simhash_anchors": op9_simhash_anchors,
    "op10_topk_segments": op10_topk_segments,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _escaped(text: str) -> str:
    from driftline.llm.chat_format import CONTROL

    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def _op6_sql() -> str:
    return f"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM raw
), p AS (
  SELECT *, length({_escaped("text")})
    + CASE WHEN before IS NULL THEN 4 + length(replace({_escaped("role")}, chr(10), '\\' || chr(10)))
           WHEN before <> role THEN 8 + length(replace({_escaped("role")}, chr(10), '\\' || chr(10))) ELSE 5 END AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) + 4 AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id"""


_OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id),
bb AS (SELECT row_number() OVER () AS it, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
bt AS (SELECT it, unnest(w) AS t, generate_subscripts(w, 1) AS off FROM bb),
dp AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
tf AS (SELECT t, count(*) AS cf FROM dp GROUP BY t),
rk AS (SELECT it, t, off, coalesce(cf, 0) AS cf, row_number() OVER (PARTITION BY it ORDER BY coalesce(cf, 0), off) AS r FROM bt LEFT JOIN tf USING (t)),
pr AS (SELECT * FROM rk WHERE r <= 3),
ok AS (SELECT it, count(*) AS k FROM pr GROUP BY it HAVING min(cf) > 0),
a AS (SELECT doc_id, it, k, p - off AS base FROM pr JOIN ok USING (it) JOIN dp USING (t) WHERE r = 1),
mt AS (SELECT a.doc_id, a.it, a.k, a.base, count(DISTINCT pr.off) AS c
  FROM a JOIN pr ON pr.it = a.it AND pr.r > 1 JOIN dp ON dp.doc_id = a.doc_id AND dp.t = pr.t AND abs(dp.p - (a.base + pr.off)) <= 5 GROUP BY ALL),
nr AS (SELECT doc_id, count(DISTINCT it) AS n_near FROM (SELECT doc_id, it FROM mt WHERE c = k - 1 UNION ALL SELECT doc_id, it FROM a WHERE k = 1) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(q.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(q.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated, coalesce(nr.n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN nr USING (doc_id)"""

_OP8_SQL = """
WITH c AS (
  SELECT page_id, DATE '2024-01-01' + CAST(((page_id * 37) % 366 + 366) % 366 AS INTEGER) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:@]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)', 1) AS seg FROM pages
), hs AS (SELECT DISTINCT host AS v, md5(host) AS m FROM c WHERE host <> ''),
ds AS (SELECT DISTINCT substr(v, instr(v, '.') + 1) AS v FROM hs WHERE v LIKE '%.%.%.%'),
ps AS (SELECT DISTINCT host || '/' || seg AS v FROM c WHERE host <> '' AND seg <> ''),
n AS (SELECT v, m, CAST('0x' || substr(m, 1, 1) AS INT) AS a, CAST('0x' || substr(m, 2, 2) AS INT) AS d1, CAST('0x' || substr(m, 4, 1) AS INT) AS d4,
             CAST('0x' || substr(m, 5, 2) AS INT) AS d5, CAST('0x' || substr(m, 7, 1) AS INT) AS d7, CAST('0x' || substr(m, 8, 1) AS INT) AS d8,
             CAST('0x' || substr(m, 9, 1) AS INT) AS d9, CAST('0x' || substr(m, 10, 2) AS INT) AS d10 FROM hs),
e AS (
  SELECT 'spam' AS list_name, v, 'add' AS action, d1 AS day FROM n WHERE a < 6
  UNION ALL SELECT 'spam', v, 'remove', d1 + 30 + d4 FROM n WHERE a < 6 AND d7 < 10
  UNION ALL SELECT 'spam', v, 'add', d1 + 60 + d5 FROM n WHERE a < 6 AND d8 < 5
  UNION ALL SELECT 'adult', v, 'add', d10 FROM n WHERE d9 < 3
  UNION ALL SELECT 'domains', v, 'add', CAST('0x' || substr(md5(v), 2, 2) AS INT) FROM ds WHERE CAST('0x' || substr(md5(v), 1, 1) AS INT) < 4
  UNION ALL SELECT 'paths', v, 'add', CAST('0x' || substr(md5(v), 2, 2) AS INT) FROM ps WHERE CAST('0x' || substr(md5(v), 1, 1) AS INT) < 5
), g AS (SELECT list_name, v, day, max(action) AS action FROM e GROUP BY ALL),
iv AS (SELECT list_name, v, action, DATE '2024-01-01' + day AS f, lead(DATE '2024-01-01' + day) OVER (PARTITION BY list_name, v ORDER BY day) AS t FROM g),
hit AS (
  SELECT page_id, list_name FROM c JOIN iv ON (c.host = iv.v OR ends_with(c.host, '.' || iv.v) OR c.host || '/' || c.seg = iv.v)
  WHERE iv.action = 'add' AND c.fetched >= iv.f AND (iv.t IS NULL OR c.fetched < iv.t) GROUP BY ALL
), l AS (SELECT page_id, count(*) AS n, string_agg(list_name, ',' ORDER BY list_name) AS lists FROM hit GROUP BY page_id)
SELECT c.page_id, coalesce(l.n, 0) > 0 AS blocked, coalesce(l.n, 0) AS n_lists, coalesce(l.lists, '') AS lists FROM c LEFT JOIN l USING (page_id)"""

_OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT::DOUBLE for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([coalesce(isfinite(x), false) for x in embedding]), true)
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_dot_product(q.v, c.v), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 20"""

SQL: dict[str, str] = {"op6_chat_format": _op6_sql(), "op7_decontaminate": _OP7_SQL, "op8_url_filters": _OP8_SQL, "op10_topk_segments": _OP10_SQL}
