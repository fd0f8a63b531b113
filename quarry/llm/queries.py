"""The queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.ann import nearest_neighbours
from quarry.llm.bpe import bpe_digests
from quarry.llm.chat import chat_digests
from quarry.llm.jaccard_join import Threshold, jaccard_join
from quarry.llm.mixing import mix_sizes
from quarry.llm.ppm import ppm_scores
from quarry.llm.quality import classify
from quarry.llm.token_count import token_counts
from quarry.llm.url_filter import WORDS, host_path, judge
from quarry.llm.vafile import top_inner_products


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), Threshold(words=3, num=90, den=100)).select("doc_id", "n_shingles", "component_id", "n_links")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Host and path rules of the URL query, in no order of rank.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"), [host_path(*r) for r in RULES])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(_table(spark, sf_dir, "documents"))


#: The two turns of conversation -1, which hold control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted conversations, and what the machine over roles says of each: valid, broken."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{CONTROL}'), (-1L, 1L, 'assistant', '{CONTROL}') AS t(conv_id, turn, role, text)")
    return chat_digests(turns.unionByName(added))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_inner_products(vectors, vectors.where("vec_id % 50 = 0"), k=5)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_nearest_neighbours, op3_token_counts, op4_url_filter, op5_mix_sources, op6_quality_classifier, op7_bpe_round_trip, op8_ppm_scores, op9_chat_format, op10_exact_top_k)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.d = d.doc_id)::BIGINT AS component_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id)::BIGINT AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op4_url_filter": rf"""
WITH r(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}),
u AS (SELECT page_id, {_LOWER.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT u.*, (SELECT max({{'n': length(rule), 'rule': rule, 'verdict': verdict}}) FROM r WHERE (u.host = split_part(rule, '/', 1) OR ends_with(u.host, '.' || split_part(rule, '/', 1))) AND starts_with(u.path, substr(rule, strpos(rule, '/')))) AS best FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN len(list_intersect(regexp_split_to_array(host, '[^A-Za-z0-9]+'), {list(WORDS)})) > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM f""",
    "op9_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
o AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(lag(role) OVER w, '') AS b FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, CASE role WHEN 'system' THEN b = '' WHEN 'user' THEN b IN ('', 'system', 'assistant') WHEN 'assistant' THEN b = 'user' ELSE false END AS may FROM o)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
bool_and(may) AND arg_max(role, i) = 'assistant' AS valid, (min(i) FILTER (WHERE NOT may))::INTEGER AS broken
FROM s GROUP BY conv_id""",
    "op10_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
