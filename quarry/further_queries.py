"""The queries of retrieval, structured plans, chunks, split tables, rules, task states and image headers, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import images as I
from quarry.functions import json_text as J
from quarry.functions.cuts import shared_folder
from quarry.functions.paths import inside
from quarry.functions.text import once
from quarry.operators import repairs as M
from quarry.operators import taxonomy as X
from quarry.plans import retrieval as Y
from quarry.plans import search as P
from quarry.queries import _LOGS, _NL, _REG, _STRICT, _WS, FACETS, FORBID, _day, _fts, _kind, _pick, _s, _tr, _values
from quarry.sources import registry as R
from quarry.streaming import events as Z

MESSAGE = "4 derniers bulletins de paie 2024"
NOWHERE = "zzqx qqzz"
#: Structured queries as a model may write them.
PLANS = [
    '{"docTypes": ["rib", 3, null, "avis"], "entities": null, "limit": "3 documents"}', '{"category": "  bank ", "subcategory": " ", "limit": 9999}', '{"keywords": "x"}', '{"limit": true}', "[1]", "null", "not json", '{"limit": 3} x', '{}, {}', '{"dateFrom": "2024-01-01", "dateTo": null, "notTerms": [], "limit": 7}',
    '{"limit": 2.5, "keywords": ["é", ""]}', '{"limit": "-4"}', '{"limit": 50.0}', '{"category": 5}', "{}", '{"limit": {"a": 1}}', '{"limit": "abc", "docTypes": [["x"], {"y": 1}, "z"]}',
]
KEYWORDS = ['["edf", 3, "sfr "]', "edf, sfr ,,edf", "", "  ", '{"a": 1}', "7", '["a"', "é,,É, é", "a,b,c,d,e,f,g,h,i,j,k,l", "[]"]
#: Tables whose rows came apart, and texts that end in tables.
SPLIT = [
    "", "| a | b | c |\n|---|---|---|\n| x | 1 | 2 |\n\n## Base - 03kVA\n\n| 9,16 | 31,62 |\n\nend", "| p | q |\n|---|---|\n| u | 1 | 2 |\n| v | 3 | 4% |\n\n### Neuf du  01\n| 9,16 | (3) |", "| a | b |\n|---|---|\n| 1 | 2 |\n\n# Titre:\n| 3 |\n", "| a | b |\n|---|---|\n\n# T\n| 3 |\n| 4 |",
    "| Prix | TVA |\n|--:|---|\n| Base | 9,16 | 20,0% |\n| Heures | -3 | 5 € |", "| Prix | TVA |\n|---|---|\n| 7 | 9,16 | 20% |", "| a | b |\n|---|---|\n" + "texte\n" * 9 + "# Loin\n| 5 |", "| a | b |\n|:-:|---|\n| x | y |", "|---|---|\n| x | y |", "# H\n| 1 | 2 |", "| a | b | c |\n|---|---|---|\n|x|y|z|\n\n# Seul\n| 1 | deux |\n",
]
CURATED = [(1, "education", "northwind", "northwind"), (2, "bank", "bnp", "bnp,paribas")]
LEARNED = [(1, "invoices", "edf", "edf"), (2, "health", "ameli", "ameli")]
HINTS = [(1, "invoices", "foncia", "housing", "foncia", "It exists."), (2, "", "", "bank", "", "Bank."), (3, "a", "b", "", "x", "no"), (4, None, "edf", "invoices", "edf", "Reuse."), (5, "x", None, "y", "z", "")]
PATHS = ["C:/raws/a.pdf", "c:\\RAWS", "C:/rawsx/a", "D:/archive/../x", "D:/archive/b/c.pdf", "", "raws/a"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _registry(f):
    return lambda s, d: f(R.registry(s, d))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return _docs(spark, sf_dir).select(i.alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), R.dealt(SPLIT, i)).alias("text"))


def _hashed(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", F.md5("text").alias("md5"), *more)


def _plans(docs: DataFrame) -> DataFrame:
    rows = once(docs, ["id"], "x", Y.parsed_plan(R.dealt(PLANS, F.col("id"))).alias("q"))
    lists = [F.array_join(f"x.q.{c}", "|").alias(c) for c in Y.TERMS]
    return rows.select("id", F.col("x.q").isNotNull().alias("ok"), *lists, *(F.col(f"x.q.{c}").alias(c) for c in Y.TEXTS), F.col("x.q.limit").alias("most"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    piece = lambda n: R.dealt(SPLIT, i + n)
    each = F.array(*(F.struct(F.lit(n).alias("chunk"), p.alias("text")) for n, p in enumerate((F.coalesce("text", F.lit("")), piece(1), piece(4), piece(8)))))
    return _docs(spark, sf_dir).select(i.alias("id"), F.explode(each).alias("p")).select("id", "p.chunk", "p.text")


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    action = F.when(i % 23 == 0, "reset").when(i % 11 == 0, "start").when(i % 13 == 0, "finish").when(i % 17 == 0, "fail").when(i % 19 == 0, "pause").otherwise("update")
    return e.select((F.col("user_id") % 20).alias("task"), i.alias("seq"), action.alias("action"), F.when(i % 3 == 0, 200).when(i % 3 == 1, 0).alias("total"), F.floor("value").alias("processed"), F.when(i % 4 == 0, F.col("event_type")).alias("stage"))


def _listing(docs: DataFrame) -> DataFrame:
    i = F.col("id")
    return docs.select(F.concat("original_path", F.lit("#"), i.cast("string")).alias("path"), (i % 50).cast("double").alias("mtime_ms"), (i % 7).alias("size"))


def stream_unblocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of files, written as a polled folder would be, as a stream against the blocked ones."""
    files = _listing(R.registry(spark, sf_dir))
    folder = f"{shared_folder(spark)}/polled-{uuid.uuid4().hex}"
    files.write.parquet(folder)
    blocked = files.where("size = 3 OR mtime_ms = 8").withColumn("mtime_ms", F.when(F.col("size") == 3, F.col("mtime_ms")).otherwise(F.col("mtime_ms") + 1))
    return Z.stream_unblocked(spark, folder, blocked)


def _hex(x: Column, width: int) -> Column:
    return F.lpad(F.hex(x), width, "0")


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content): a header of a PNG, of a JPEG with or without EXIF, or of nothing, made of each document's id."""
    i = F.col("doc_id")
    w, h, tag = (i % 900 + 1).cast("long"), (i * 7 % 1200).cast("long"), i % 10
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 8), _hex(h, 8))
    frame = F.concat(F.lit("FFC000110800"), F.lit(""), F.substring(_hex(h, 4), 3, 2), _hex(w, 4), F.lit("03"))
    frame = F.concat(F.lit("FFC0001108"), _hex(h, 4), _hex(w, 4), F.lit("03000000"))
    exif = F.concat(F.lit("FFE10022457869660000"), F.when(i % 2 == 0, F.concat(F.lit("49492A0008000000010012010300010000"), F.lit("00"), _hex(tag, 2), F.lit("000000"))).otherwise(F.concat(F.lit("4D4D002A0000000800010112000300000001"), _hex(tag, 4), F.lit("0000"))))
    jpeg = F.concat(F.lit("FFD8"), F.when(i % 3 == 0, exif).otherwise("FFE00004AAAA"), F.lit("FFC40003AA"), frame)
    text = F.when(i % 5 == 0, png).when(i % 5 == 1, F.substring(jpeg, 1, 20)).when(i % 5 == 2, "48656C6C6F").otherwise(jpeg)
    return _docs(spark, sf_dir).select(i.alias("id"), F.unhex(text).alias("content"))


def _headers(rows: DataFrame) -> DataFrame:
    found = rows.select("id", I.dimensions("content").alias("s"), I.exif_orientation("content").alias("tag"))
    return found.select("id", "s.width", "s.height", "tag", I.turn(F.col("tag")).alias("degrees"))


def _sharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    near = (F.floor(v * k % 256).cast("double") for k in (2, 3, 5, 7))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(I.sharpened(F.floor(v).cast("double"), *near, 40.0), 6).alias("grey"))


def _guards(docs: DataFrame) -> DataFrame:
    path = R.dealt(PATHS, F.col("id"))
    return docs.select("id", X.narrow_forbidden(F.col("subcategory")).alias("forbidden"), X.generic_category(F.when(F.col("id") % 3 == 0, " Other ").when(F.col("id") % 3 == 1, F.col("category"))).alias("generic"), (inside(path, "C:/raws") | inside(path, "D:/archive")).alias("managed"))


QUERIES = {
    "retrieve": _registry(lambda d: Y.retrieved(d, MESSAGE)),
    "retrieve_fallback": _registry(lambda d: Y.retrieved(d, NOWHERE)),
    "answer_documents": _registry(lambda d: Y.formatted(d.withColumn("original_filename", F.when(F.col("id") % 4 > 0, F.col("original_filename")).otherwise("")))),
    "answer_prompt": _registry(lambda d: Y.prompt(d, P.search(d, FACETS), "Bonjour")),
    "plan_parse": _registry(_plans),
    "keyword_lists": _registry(lambda d: d.select("id", F.array_join(J.stored_keywords(R.dealt(KEYWORDS, F.col("id"))), "|").alias("stored"), F.array_join(J.edited_keywords(R.dealt(KEYWORDS, F.col("id"))), "|").alias("edited"))),
    "chunk_text": lambda s, d: M.chunks(_docs(s, d).select(F.col("doc_id").alias("id"), "text")).select("id", F.col("chunk").cast("long").alias("chunk"), F.md5("text").alias("md5")),
    "md_reattach": lambda s, d: _hashed(M.reattached(_split(s, d)), "rows"),
    "md_header_restore": lambda s, d: _hashed(M.header_restored(_split(s, d)), "headers"),
    "md_repair": lambda s, d: _hashed(M.repaired(_split(s, d))),
    "open_table_tail": lambda s, d: _split(s, d).select("id", M.open_table("text").alias("o")).select("id", "o.header", "o.separator"),
    "chunk_join": lambda s, d: _hashed(M.joined(_parts(s, d))),
    "rules_composed": lambda s, d: X.composed_rules(*(s.createDataFrame(x, "ord int, category string, subcategory string, keywords string") for x in (CURATED, LEARNED))),
    "hint_lines": lambda s, d: X.hint_lines(s.createDataFrame(HINTS, "ord int, proposed_category string, proposed_subcategory string, mapped_category string, mapped_subcategory string, hint string")),
    "task_states": lambda s, d: Z.task_states(_actions(s, d)),
    "log_session_order": lambda s, d: Z.session_order(Z.logs(s.read.parquet(f"{d}/events.parquet")).groupBy("filename").agg(F.max("stamp").alias("last"), F.min("event_id").alias("first_id"))),
    "stream_unblocked": stream_unblocked,
    "image_headers": lambda s, d: _headers(_pictures(s, d)),
    "sharpen": _sharp,
    "guard_predicates": _registry(_guards),
    "blocked_names": _registry(lambda d: X.numbered(d.select("id", F.col("original_filename").alias("name")), "blocked")),
}

# --- SQL ---------------------------------------------------------------------------------------------------------


def _answered() -> str:
    """Rows of the first rung of the plan, one payslip a month, as many as were asked for."""
    plan = P.Query(keywords=("derniers", "bulletins", "paie"), date_from="2024-01-01", date_to="2024-12-31")
    month = f"strftime(DATE '1970-01-01' + {_day('date')}::INT, '%Y-%m')"
    return f"""WITH {_REG}, h AS ({_fts(plan, 12)}), k AS (SELECT h.rank, h.id, CASE WHEN lower(category) <> 'bulletin_salaire' THEN '#' || r.id WHEN {_day('date')} = 0 THEN '?' || r.id ELSE {month} END AS k FROM h JOIN r USING (id)), o AS (SELECT rank, id FROM k QUALIFY id = max(id) OVER (PARTITION BY k))
SELECT row_number() OVER (ORDER BY rank)::INT AS rank, id FROM o ORDER BY rank LIMIT 4"""


_SP = f"tb AS (SELECT doc_id AS id, coalesce(text, '') || chr(10) || chr(10) || {_pick(SPLIT)} AS text FROM documents), ln AS (SELECT id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) - 1 AS ln FROM tb)"
_ROWRE, _SEPRE = rf"^{_WS}*\|{_NL}*\|{_WS}*$", rf"^{_WS}*\|{_WS[:-1]}:|-]+\|{_WS}*$"
_BARE = f"regexp_replace(regexp_replace({_tr('line')}, '^\\|', ''), '\\|$', '')"
_CELLS = f"list_transform(string_split({_BARE}, '|'), lambda c: {_tr('c')})"
_VALUE = f"^[-–—−]?{_WS}*\\(?\\d[\\d{_WS[1:-1]}.,€%]*(?:\\){_WS}*)?$"
#: Rows and blocks of tables: s and e the first and last line, sa the separator's, header its width, dw the one width of the other rows, if there is one.
_BL = f"""{_SP}, rw AS (SELECT id, ln, line, ln - row_number() OVER (PARTITION BY id ORDER BY ln) AS g, {_CELLS} AS cl, regexp_matches(line, '{_SEPRE}') AS sep FROM ln WHERE regexp_matches(line, '{_ROWRE}')),
b0 AS (SELECT id, g, min(ln) AS s, max(ln) AS e, min(ln) FILTER (WHERE sep) AS sa FROM rw GROUP BY id, g),
bl AS (SELECT b.*, (SELECT len(cl) FROM rw WHERE rw.id = b.id AND rw.ln = CASE WHEN sa > s THEN sa - 1 ELSE sa END) AS header FROM b0 b),
dt AS (SELECT bl.id, bl.g, min(len(cl)) AS lo, max(len(cl)) AS hi, count(*) AS n, bool_and(len(cl) = header + 1) AS wider, bool_and(regexp_matches(cl[-1], '{_VALUE}')) AS ends, bool_or(regexp_matches(cl[1], '{_VALUE}')) AS begins FROM bl JOIN rw USING (id, g) WHERE sa IS NOT NULL AND ln <> sa AND ln <> sa - 1 GROUP BY ALL)"""
_REATTACH = f"""{_BL}, t AS (SELECT id, ln, {_tr('line')} AS t FROM ln), f AS (SELECT id, ln, t, lead(ln) OVER w AS r, lead(t) OVER w AS rt, lead(t, 2) OVER w AS nt FROM t WHERE t <> '' WINDOW w AS (PARTITION BY id ORDER BY ln)),
h AS (SELECT f.id, f.ln, f.r, f.t, list_transform(string_split(regexp_replace(regexp_replace(rt, '^\\|', ''), '\\|$', ''), '|'), lambda c: {_tr('c')}) AS own, (SELECT max({{'e': e, 'header': header, 'g': g}}) FROM bl WHERE bl.id = f.id AND e < f.ln AND header IS NOT NULL) AS p FROM f
WHERE regexp_matches(t, '^#{{1,6}}{_WS}+[^{_WS[1:]}') AND regexp_matches(rt, '{_ROWRE}') AND NOT regexp_matches(rt, '{_SEPRE}') AND (nt IS NULL OR NOT regexp_matches(nt, '{_ROWRE}'))),
q AS (SELECT h.*, regexp_replace({_tr(f"regexp_replace(t, '^#{{1,6}}{_WS}+', '')")}, '{_WS}+', ' ', 'g') AS said, CASE WHEN dt.lo = dt.hi AND dt.lo > p.header THEN dt.lo ELSE p.header END AS wide, (SELECT count(*) FROM f WHERE f.id = h.id AND f.ln > p.e AND f.ln < h.ln) AS gap FROM h LEFT JOIN dt ON dt.id = h.id AND dt.g = p.g WHERE p IS NOT NULL),
fo AS (SELECT id, ln, r, p.e AS e, '| ' || said || ' | ' || array_to_string(own, ' | ') || ' |' AS line FROM q WHERE len(own) >= 2 AND len(list_filter(own, lambda c: NOT regexp_matches(c, '{_VALUE}'))) = 0 AND len(own) + 1 = wide AND gap <= 8 AND said <> '' AND NOT ends_with(said, ':')),
lo AS (SELECT id, ln, -1 AS k, line FROM ln WHERE NOT EXISTS (SELECT 1 FROM fo WHERE fo.id = ln.id AND (fo.ln = ln.ln OR fo.r = ln.ln)) UNION ALL SELECT id, e, ln, line FROM fo), n AS (SELECT id, count(*) AS n FROM fo GROUP BY id), o AS (SELECT id, string_agg(line, chr(10) ORDER BY ln, k) AS x FROM lo GROUP BY id)"""
_CH = f"""RECURSIVE d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), ln AS (SELECT id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) AS ln FROM d WHERE length(text) > 1400),
p AS (SELECT id, ln, 0 AS k, NULL::VARCHAR AS piece, line AS rest, length(line) > 1400 AS more FROM ln UNION ALL
SELECT id, ln, k + 1, CASE WHEN more THEN left(rest, cut) ELSE rest END, CASE WHEN more THEN ltrim(substr(rest, cut + 1), ' ') END, more AND length(ltrim(substr(rest, cut + 1), ' ')) > 1400 FROM (SELECT *, CASE WHEN strpos(left(rest, 1401), ' ') > 0 AND length(left(rest, 1401)) - strpos(reverse(left(rest, 1401)), ' ') >= 700 THEN length(left(rest, 1401)) - strpos(reverse(left(rest, 1401)), ' ') ELSE 1400 END AS cut FROM p WHERE rest IS NOT NULL) WHERE more OR rest <> '' OR k = 0),
q AS (SELECT id, piece, length(piece) + 1 AS u, row_number() OVER (PARTITION BY id ORDER BY ln, k) AS i FROM p WHERE k > 0),
c AS (SELECT id, i, 0 AS chunk, u AS used FROM q WHERE i = 1 UNION ALL SELECT q.id, q.i, CASE WHEN c.used + q.u > 1400 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.used + q.u > 1400 THEN q.u ELSE c.used + q.u END FROM c JOIN q ON q.id = c.id AND q.i = c.i + 1),
g AS (SELECT c.id, c.chunk, {_tr("string_agg(q.piece || chr(10), '' ORDER BY c.i)")} AS text FROM c JOIN q USING (id, i) GROUP BY c.id, c.chunk)"""
_IMG = "im AS (SELECT doc_id AS id, doc_id % 900 + 1 AS w, doc_id * 7 % 1200 AS h, CASE WHEN doc_id % 5 IN (3, 4) AND doc_id % 3 = 0 THEN doc_id % 10 END AS tag FROM documents)"

ORACLE_SQL = {
    "retrieve": _answered(),
    "retrieve_fallback": f"""WITH {_REG}, n AS (SELECT id, category, {_day('date')} AS day, row_number() OVER (ORDER BY {_day('date')} DESC, id DESC) AS place FROM r ORDER BY place LIMIT 5), k AS (SELECT *, CASE WHEN lower(category) <> 'bulletin_salaire' THEN '#' || id WHEN day = 0 THEN '?' || id ELSE strftime(DATE '1970-01-01' + day::INT, '%Y-%m') END AS k FROM n), o AS (SELECT place, id FROM k QUALIFY id = max(id) OVER (PARTITION BY k))
SELECT row_number() OVER (ORDER BY place)::INT AS rank, id FROM o""",
    "answer_documents": f"""WITH {_REG}, n AS (SELECT *, CASE WHEN id % 4 > 0 THEN original_filename ELSE title END AS fn FROM r) SELECT id, checksum, title, date, category, coalesce(nullif(subcategory, ''), 'general') AS subcategory, summary, total_amount, fn AS original_filename, coalesce(nullif(new_path, ''), original_path) AS new_path, coalesce(nullif(file_type, ''), {_kind('fn')}) AS file_type FROM n""",
    "answer_prompt": f"""WITH {_REG}, h AS ({_fts(FACETS)}) SELECT 'Documents disponibles dans la base locale (via MCP):' || chr(10) || string_agg('[Doc #' || r.id || '] Title: "' || title || '" | Format: ' || coalesce(nullif(file_type, ''), {_kind('original_filename')}) || ' | Category: ' || category || CASE WHEN subcategory = '' THEN '' ELSE '/' || subcategory END || ' | Date: ' || coalesce(nullif(date, ''), 'N/A') || ' | Amount: ' || coalesce(nullif(total_amount, ''), 'N/A') || chr(10) || 'Summary: ' || summary, chr(10) || chr(10) ORDER BY h.rank) || chr(10) || chr(10) || 'Demande de l''utilisateur: "Bonjour"' AS prompt FROM h JOIN r ON r.id = h.id""",
    "plan_parse": f"""WITH t AS (SELECT doc_id AS id, try_cast({_pick(PLANS)} AS JSON) AS j FROM documents), k AS (SELECT *, json_type(j) AS t, {", ".join(f"json_type(j, '$.{c}') AS t_{c}" for c in (*Y.TERMS, *Y.TEXTS, 'limit'))} FROM t),
o AS (SELECT *, coalesce(t = 'OBJECT', false) AND {" AND ".join(f"coalesce(t_{c}, 'NULL') IN ('NULL', 'ARRAY')" for c in Y.TERMS)} AND {" AND ".join(f"coalesce(t_{c}, 'NULL') IN ('NULL', 'VARCHAR')" for c in Y.TEXTS)} AND coalesce(t_limit, 'NULL') NOT IN ('BOOLEAN', 'OBJECT', 'ARRAY') AS ok FROM k),
l AS (SELECT *, CASE WHEN t_limit = 'VARCHAR' THEN try_cast(regexp_extract(j ->> '$.limit', '^\\s*([+-]?[0-9]+)', 1) AS INT) WHEN try_cast(j ->> '$.limit' AS DOUBLE) = floor(try_cast(j ->> '$.limit' AS DOUBLE)) THEN (j ->> '$.limit')::DOUBLE::INT END AS n FROM o)
SELECT id, ok, {", ".join(f"CASE WHEN ok THEN coalesce(array_to_string(list_transform(list_filter(json_extract(j, '$.{c}[*]'), lambda e: json_type(e) = 'VARCHAR'), lambda e: e ->> '$'), '|'), '') END AS {c}" for c in Y.TERMS)},
{", ".join(f"CASE WHEN ok THEN nullif(trim(j ->> '$.{c}'), '') END AS {c}" for c in Y.TEXTS)}, CASE WHEN ok AND n BETWEEN 1 AND 50 THEN n END AS most FROM l""",
    "keyword_lists": f"""WITH t AS (SELECT doc_id AS id, {_pick(KEYWORDS)} AS c, try_cast({_pick(KEYWORDS)} AS JSON) AS j FROM documents), p AS (SELECT *, list_filter(list_transform(string_split(c, ','), lambda x: trim(x)), lambda x: x <> '') AS w FROM t)
SELECT id, CASE WHEN trim(c) = '' THEN '' WHEN j IS NOT NULL THEN coalesce(CASE WHEN json_type(j) = 'ARRAY' THEN array_to_string(list_transform(list_filter(json_extract(j, '$[*]'), lambda e: json_type(e) = 'VARCHAR'), lambda e: e ->> '$'), '|') END, '') ELSE array_to_string(w, '|') END AS stored, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:10], '|') AS edited FROM p""",
    "chunk_text": f"WITH {_CH} SELECT id, chunk::BIGINT AS chunk, md5(text) AS md5 FROM g WHERE text <> '' OR chunk < (SELECT max(chunk) FROM g o WHERE o.id = g.id) UNION ALL SELECT id, 0, md5(text) FROM d WHERE length(text) <= 1400",
    "md_reattach": f"WITH {_REATTACH} SELECT tb.id, md5(CASE WHEN n IS NULL THEN tb.text ELSE x END) AS md5, coalesce(n, 0) AS rows FROM tb LEFT JOIN n USING (id) LEFT JOIN o USING (id)",
    "md_header_restore": f"""WITH {_BL}, sh AS (SELECT bl.id, bl.sa FROM bl JOIN dt USING (id, g) WHERE sa > s AND header >= 2 AND wider AND ends AND NOT begins), o AS (SELECT ln.id, string_agg(CASE WHEN sh.sa IS NULL THEN line ELSE '|  | ' || array_to_string({_CELLS}, ' | ') || ' |' END, chr(10) ORDER BY ln) AS x FROM ln LEFT JOIN sh ON sh.id = ln.id AND (ln.ln = sh.sa OR ln.ln = sh.sa - 1) GROUP BY ln.id), n AS (SELECT id, count(*) AS n FROM sh GROUP BY id)
SELECT tb.id, md5(CASE WHEN n IS NULL THEN tb.text ELSE x END) AS md5, coalesce(n, 0) AS headers FROM tb LEFT JOIN n USING (id) LEFT JOIN o USING (id)""",
    "open_table_tail": f"""WITH {_SP}, t AS (SELECT id, ln, {_tr('line')} AS t FROM ln), e AS (SELECT id, max(ln) FILTER (WHERE t <> '') AS e FROM t GROUP BY id), n AS (SELECT e.id, e, coalesce(max(ln) FILTER (WHERE ln < e AND NOT regexp_matches(t, '{_ROWRE}')), -1) AS nr FROM e JOIN t USING (id) GROUP BY ALL),
s AS (SELECT n.id, n.e, max(ln) FILTER (WHERE ln > nr AND ln <= n.e AND regexp_matches(t, '{_STRICT}')) AS sa FROM n JOIN t USING (id) GROUP BY ALL), j AS (SELECT s.id, s.sa, a.t AS tail, b.t AS sep, c.t AS head FROM s LEFT JOIN t a ON a.id = s.id AND a.ln = s.e LEFT JOIN t b ON b.id = s.id AND b.ln = s.sa LEFT JOIN t c ON c.id = s.id AND c.ln = s.sa - 1)
SELECT id, CASE WHEN ok THEN head END AS header, CASE WHEN ok THEN sep END AS separator FROM (SELECT *, coalesce(regexp_matches(tail, '{_ROWRE}') AND NOT regexp_matches(tail, '{_STRICT}') AND sa > 0 AND regexp_matches(head, '{_ROWRE}'), false) AS ok FROM j)""",
    "chunk_join": f"""WITH p AS (SELECT doc_id AS id, unnest([0, 1, 2, 3]) AS chunk, unnest([coalesce(text, ''), {_pick(SPLIT, '(doc_id + 1)')}, {_pick(SPLIT, '(doc_id + 4)')}, {_pick(SPLIT, '(doc_id + 8)')}]) AS text FROM documents), l AS (SELECT *, lag(text) OVER (PARTITION BY id ORDER BY chunk) AS b FROM p),
k AS (SELECT *, regexp_matches(regexp_split_to_array(regexp_replace(b, '{_WS}+$', ''), '\\r?\\n')[-1], '^\\|{_NL}*\\|{_WS}*$') AND regexp_matches(regexp_split_to_array(regexp_replace(text, '^{_WS}+', ''), '\\r?\\n')[1], '^\\|{_NL}*\\|') AS on_ FROM l)
SELECT id, md5(string_agg(CASE WHEN b IS NULL THEN '' WHEN on_ THEN chr(10) ELSE chr(10) || chr(10) END || text, '' ORDER BY chunk)) AS md5 FROM k GROUP BY id""",
    "rules_composed": f"SELECT row_number() OVER (ORDER BY o, ord)::INT AS ord, category, subcategory, keywords, CASE o WHEN 0 THEN 'curated' ELSE 'learned' END AS origin FROM (SELECT 0 AS o, * FROM {_values(CURATED, 'ord, category, subcategory, keywords')} UNION ALL SELECT 1, * FROM {_values(LEARNED, 'ord, category, subcategory, keywords')})",
    "hint_lines": f"""SELECT ord, '- "' || CASE WHEN coalesce(a, '') || coalesce(b, '') = '' THEN '?' ELSE concat_ws('/', nullif(a, ''), nullif(b, '')) END || '" → ALWAYS use "' || concat_ws('/', nullif(c, ''), nullif(d, '')) || '". ' || h AS line FROM {_values(HINTS, 'ord, a, b, c, d, h')} WHERE c <> '' AND h <> ''""",
    "task_states": """WITH a AS (SELECT user_id % 20 AS task, event_id AS seq, CASE WHEN event_id % 23 = 0 THEN 'reset' WHEN event_id % 11 = 0 THEN 'start' WHEN event_id % 13 = 0 THEN 'finish' WHEN event_id % 17 = 0 THEN 'fail' WHEN event_id % 19 = 0 THEN 'pause' ELSE 'update' END AS x, CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 0 END AS total, floor(value)::BIGINT AS p, CASE WHEN event_id % 4 = 0 THEN event_type END AS st FROM events),
r AS (SELECT *, count(*) FILTER (WHERE x IN ('reset', 'start')) OVER (PARTITION BY task ORDER BY seq) AS run FROM a),
c AS (SELECT *, coalesce(last_value(CASE WHEN x = 'start' THEN coalesce(total, 0) WHEN x = 'update' AND total > 0 THEN total END IGNORE NULLS) OVER w, 0) AS t, coalesce(max(CASE WHEN x = 'update' THEN p END) OVER w, 0) AS d, coalesce(last_value(CASE x WHEN 'start' THEN 'STARTING' WHEN 'reset' THEN 'IDLE' WHEN 'finish' THEN 'COMPLETED' WHEN 'fail' THEN 'FAILED' WHEN 'update' THEN st END IGNORE NULLS) OVER w, 'IDLE') AS stage,
coalesce(last_value(CASE x WHEN 'start' THEN true WHEN 'finish' THEN false WHEN 'fail' THEN false WHEN 'reset' THEN false END IGNORE NULLS) OVER w, false) AS running FROM r WINDOW w AS (PARTITION BY task, run ORDER BY seq))
SELECT task, seq, running, stage, d::BIGINT AS processed, t::BIGINT AS total, coalesce(last_value(CASE x WHEN 'start' THEN 0 WHEN 'reset' THEN 0 WHEN 'finish' THEN 100 WHEN 'update' THEN CASE WHEN t > 0 THEN least(100, floor(d / t * 100 + 0.5)) ELSE 0 END END IGNORE NULLS) OVER (PARTITION BY task, run ORDER BY seq), 0)::BIGINT AS percent FROM c""",
    "log_session_order": f"WITH {_LOGS}, g AS (SELECT filename, max(stamp) AS last, min(event_id) AS f FROM lg GROUP BY filename) SELECT row_number() OVER (ORDER BY last DESC, f)::INT AS place, filename FROM g",
    "stream_unblocked": f"WITH {_REG}, f AS (SELECT original_path || '#' || id AS path, (id % 50)::DOUBLE AS mtime_ms, id % 7 AS size FROM r) SELECT * FROM f WHERE size <> 3",
    "image_headers": f"WITH {_IMG} SELECT id, CASE WHEN h > 0 AND id % 5 IN (0, 3, 4) THEN w END AS width, CASE WHEN h > 0 AND id % 5 IN (0, 3, 4) THEN h END AS height, tag, CASE tag WHEN 1 THEN 0 WHEN 3 THEN 180 WHEN 6 THEN 90 WHEN 8 THEN 270 END::BIGINT AS degrees FROM im",
    "sharpen": "WITH v AS (SELECT event_id, floor(value)::DOUBLE AS c, floor(value * 2 % 256)::DOUBLE + floor(value * 3 % 256)::DOUBLE + floor(value * 5 % 256)::DOUBLE + floor(value * 7 % 256)::DOUBLE AS s FROM events) SELECT event_id, round(greatest(0.0::DOUBLE, least(255.0::DOUBLE, 2.6::DOUBLE * c - 0.4::DOUBLE * s)), 6) AS grey FROM v",
    "guard_predicates": f"WITH {_REG}, p AS (SELECT *, lower(replace({_pick(PATHS, 'id')}, '\\', '/')) AS p FROM r) SELECT id, subcategory IN ({_s(FORBID)[1:-1]}) AS forbidden, id % 3 <> 1 OR lower(trim(category)) IN ('', 'general', 'other', 'divers') AS generic, p = 'c:/raws' OR starts_with(p, 'c:/raws/') OR p = 'd:/archive' OR starts_with(p, 'd:/archive/') AS managed FROM p",
    "blocked_names": f"WITH {_REG}, n AS (SELECT id, original_filename AS name, row_number() OVER (PARTITION BY original_filename ORDER BY id) - 1 AS i, regexp_extract(regexp_extract(original_filename, '([^/\\\\]*)$', 1), '(?s)[^.].*?(\\.[^.]*)$', 1) AS e FROM r) SELECT id, name, CASE WHEN i = 0 THEN name ELSE left(name, length(name) - length(e)) || '_blocked' || i || e END AS unique_name FROM n",
}
