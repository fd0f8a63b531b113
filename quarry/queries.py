"""The queries over the registry, and DuckDB SQL that gives the same rows, written apart from the DataFrame code."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import file_type, fold, forbidden_subcategory, generic_filename, similarity, slug
from quarry.operators import classify as C
from quarry.operators import quality as Q
from quarry.operators import taxonomy as X
from quarry.plans import search as P
from quarry.sources import registry as R
from quarry.streaming import events as Z

#: Fixed value: what the path and date queries take for today.
TODAY = "2026-02-01"
STOP = ["les", "des", "the", "and", "pdf"]

FACETS = P.Query(doc_types=("relevé de compte", "facture"), entities=("bnp", "edf"))
NEGATED = P.Query(doc_types=("the",), keywords=("arrêt de travail", "navigo"), not_terms=("bus",))
FILTERED = P.Query(keywords=("the", "de la"), category="invoices", date_from="2024-01-01", date_to="2024-12-31")
LADDER = P.Query(doc_types=("passeport",), entities=("zzqx",), keywords=("introuvable",))
MESSAGE = "j'ai besoin 2 derniers bulletins de paie housing"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(f):
    return lambda spark, sf_dir: f(R.registry(spark, sf_dir))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = ["", " 2 derniers relevés 2023", " last 3", " trois factures 2019 2021", " single 1949", " 25 documents"]
    i = F.col("conv_id") + F.col("turn")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("text", R.dealt(asked, i)).alias("message"))


def _tabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), Q.tables_of(F.col("text"), F.col("doc_id")).alias("text"))


def _mangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("th"), F.lit("tH"))).otherwise(F.col("text")).alias("text"))


def _literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


PROPOSED = [("invoices", "foncia"), ("invoices", "sfr"), ("bank", "bouyguestelecom"), ("bank", "boursorama"), ("health", "laidentail"), ("bank", "impot"), ("other", "inpi"), ("housing", "Electricité de France"), ("bank", "navigoo")]
OWNED = [("invoices", "sfr"), ("bank", "foncia"), ("bank", "edf"), ("administrative", "edf"), ("x", "nope")]
DECISIONS = [(1, "NORTHWIND_2024.pdf", "Northwind Academy — certificat de scolarité", "education", "northwind", 1), (2, "facture_les_3.pdf", "Facture EDF", "invoices", "edf", None), (3, "a.pdf", "b", "x", "y", 1), (4, "scan edf.pdf", "EDF contrat", "invoices", "general", 1), (5, "loyer.pdf", "Quittance loyer", "housing", "foncia", 0), (6, "Système santé.pdf", "Santé", "health", "ameli", 1)]
ANSWERS = [(1, "voir [Doc #3] et [doc #1: x]", [1, 2, 3], None), (2, "rien", [4, 5], None), (3, "[Doc #9]", [7, 8, 9, 10], None), (4, "[DOC #7] [Doc #99]", [7], None), (5, "[Doc #9]", [7, 8, 9, 10], 1), (6, "[Doc #9] [doc #8]", [7, 8, 9, 10], 3), (7, "[Doc #1][Doc #2]", [1, 2], 9), (8, "[Doc #77]", [1, 2], 1)]
PAGES = [(1, 1000.0, 500.0), (2, 300.0, 900.0), (3, 0.0, 10.0), (4, 595.28, 841.89), (5, 100.0, 100.0)]
BOXES = [(1, False, (0.0, 0.0, 10.0, 10.0), (1.0, 1.0, 9.0, 9.0)), (2, False, (0.0, 0.0, 10.0, 10.0), (8.0, 8.0, 9.0, 9.0)), (3, True, (0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0)), (4, False, None, None), (5, False, (0.0, 0.0, 5.0, 5.0), None), (6, False, None, (0.0, 0.0, 5.0, 5.0))]


def _files(docs: DataFrame) -> DataFrame:
    return docs.select("original_path", (F.col("id") % 50).cast("double").alias("mtime_ms"), (F.col("id") % 7).alias("size"))


def _blocked(docs: DataFrame) -> DataFrame:
    return docs.where("id % 5 = 0").select("original_path", (F.col("id") % 50).cast("double").alias("mtime_ms"), (F.col("id") % 7).alias("size")).distinct()


def partial_update(docs: DataFrame) -> DataFrame:
    i = F.col("id")
    changes = docs.where("id % 3 = 0").select("id", F.when(i % 2 == 0, "new").alias("title"), F.when(i % 4 < 3, "nouveau").alias("title_fr"), F.when(i % 5 == 0, "").alias("subcategory"), F.lit(None).cast("string").alias("subcategory_fr"))
    return R.partial_update(docs.select("id", "title", "subcategory"), changes, ("title", "subcategory"))


def scalars(docs: DataFrame) -> DataFrame:
    return docs.select("id", slug(F.col("category")).alias("slug"), fold(F.col("summary")).alias("folded"), file_type(F.col("original_filename")).alias("file_type"), forbidden_subcategory(F.col("subcategory")).alias("forbidden"), generic_filename(F.col("original_filename")).alias("generic"), F.round(similarity(slug(F.col("category")), F.lit("invoice")), 9).alias("similarity"))


QUERIES = {
    "fts_bm25_topk": _docs(lambda d: P.search(d, FACETS)),
    "fts_not": _docs(lambda d: P.search(d, NEGATED)),
    "fts_filtered": _docs(lambda d: P.search(d, FILTERED)),
    "fts_relax_ladder": _docs(lambda d: P.relaxed(d, LADDER)),
    "plan_heuristic": lambda s, d: P.plan(_messages(s, d)),
    "requested_count": lambda s, d: _messages(s, d).select("id", P.requested_count(F.col("message")).alias("n")),
    "token_scorer": _docs(lambda d: P.scored(d, MESSAGE)),
    "token_scorer_fallback": _docs(lambda d: P.scored(d, "zzqx")),
    "prepare_dossier": _docs(lambda d: P.scored(d, "QUITTANCE Housing".lower())),
    "fts_index_topk": _docs(lambda d: P.searched_by_index(d, FACETS)),
    "fts_index_not": _docs(lambda d: P.searched_by_index(d, NEGATED)),
    "doc_date_parse": _docs(lambda d: d.select("id", P.document_day(F.col("date")).alias("day"))),
    "payslip_dedupe": _docs(P.one_per_month),
    "citation_prune": lambda s, d: P.cited(_literal(s, ANSWERS, "id long, answer string, doc_ids array<long>, asked int")),
    "registry_list": _docs(lambda d: R.listing(d, category="INVOICES", q="SFR").withColumn("tags", F.array_join("tags", ","))),
    "registry_list_subcategory": _docs(lambda d: R.listing(d, subcategory="Sfr").select("id", "subcategory")),
    "registry_lookup": _docs(lambda d: R.lookup(d, 7).unionByName(R.lookup(d, checksum=hashlib.sha256(b"").hexdigest())).unionByName(R.lookup(d, -1)).select("id", "title", "checksum")),
    "tool_search": _docs(lambda d: R.tool_search(d, "santé", kind="pdf")),
    "tool_search_tail": _docs(lambda d: R.tool_search(d, "17 B", category="BANK", limit=-3)),
    "registry_csv_line": _docs(R.csv_lines),
    "registry_csv_filtered": _docs(lambda d: R.csv_lines(d, category="bank", q="sfr")),
    "registry_json_line": _docs(R.json_lines),
    "insert_defaults": _docs(lambda d: R.with_defaults(d.select("id", "subcategory", "file_type", F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.col("status")).alias("status"), F.when(F.col("id") % 2 == 0, F.col("tags")).alias("tags"), "embedding", "original_filename", F.when(F.col("id") % 5 > 0, F.col("title")).alias("title")))),
    "category_stats": _docs(R.category_stats),
    "category_tree_counts": lambda s, d: R.category_tree(R.registry(s, d), X.taxonomy(s).select("category", "subcategory")),
    "checksum_dedup": _docs(lambda d: R.first_by_checksum(d.where("id % 10 <> 0"), d.where("id % 10 = 0"))),
    "blocked_skip": _docs(lambda d: R.unblocked(_files(d), _blocked(d)).groupBy("original_path").agg(F.count("*").alias("n"))),
    "partial_update": _docs(partial_update),
    "collision_names": _docs(lambda d: R.collision_names(d.select("id", F.col("title").alias("name")))),
    "clean_text": _docs(lambda d: d.select("id", Q.clean(F.concat(F.lit(" \r\n\n\n"), F.replace("raw_text", F.lit(". "), F.lit(".\r\n\r\n\n")))).alias("t")).select("id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("md5"))),
    "no_text_block": lambda s, d: _table(s, d, "documents").select(F.col("doc_id").alias("id"), Q.no_text(F.col("text")).alias("blocked")),
    "prose_score": lambda s, d: _table(s, d, "documents").select(F.col("doc_id").alias("id"), Q.prose(F.col("text")).alias("p")).select("id", "p.tokens", "p.score"),
    "corruption_windows": lambda s, d: Q.corruption(_mangled(s, d)),
    "thin_layer": lambda s, d: Q.thin_layer(_table(s, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 == 0, "watermark\nwatermark\nwatermark").otherwise(F.col("text")).alias("text"), ((F.col("doc_id") % 5) * 4).alias("pages"))),
    "content_recall": _docs(lambda d: Q.recall(d.select("id", F.col("raw_text").alias("raw"), F.when(F.col("id") % 2 == 0, F.regexp_replace("raw_text", "[a-zà-ÿ]*[eo]n[a-zà-ÿ]*", "x")).otherwise(F.col("raw_text")).alias("markdown")))),
    "malformed_pipes": lambda s, d: _tabled(s, d).select("id", Q.malformed_lines("text").alias("n")),
    "md_edge_pipes": lambda s, d: _tabled(s, d).select("id", F.md5(Q.edge_pipes("text")).alias("md5")),
    "md_table_audit": lambda s, d: Q.audit(_tabled(s, d)),
    "md_table_blocks": lambda s, d: Q.table_blocks(_tabled(s, d)),
    "scalar_functions": _docs(scalars),
    "entity_match": lambda s, d: C.entity_match(R.registry(s, d).select("id", F.col("raw_text").alias("text")), C.dictionary(s)),
    "priority_override": lambda s, d: C.priority_override(R.registry(s, d).select("id", F.when(F.col("id") % 3 == 0, "other").otherwise(F.col("category")).alias("category"), "subcategory").join(C.entity_match(R.registry(s, d).select("id", F.col("raw_text").alias("text")), C.dictionary(s)), "id", "left")),
    "subcategory_conflict": lambda s, d: X.subcategory_conflicts(_literal(s, PROPOSED, "category string, subcategory string"), X.taxonomy(s)),
    "canonical_owner": lambda s, d: X.canonical_owner(_literal(s, OWNED, "category string, subcategory string"), X.taxonomy(s)),
    "taxonomy_merge": lambda s, d: X.merge_subcategory(X.taxonomy(s), "invoices", "bouygues_telecom", "sfr"),
    "derive_keywords": lambda s, d: X.derive_keywords(_literal(s, DECISIONS, "id long, original_filename string, title string, category string, subcategory string, enabled int"), STOP),
    "priority_rules": lambda s, d: X.priority_rules(_literal(s, DECISIONS, "id long, original_filename string, title string, category string, subcategory string, enabled int"), STOP),
    "canonical_path": _docs(lambda d: X.canonical_paths(d, "root", TODAY)),
    "log_sessions": lambda s, d: Z.sessions(Z.logs(_table(s, d, "events"))),
    "recent_ring": lambda s, d: Z.ring(Z.logs(_table(s, d, "events"))),
    "rate_limit": lambda s, d: Z.rate_limited(_table(s, d, "events"), 86400),
    "stream_log_sessions": Z.stream_sessions,
    "stream_dedup": Z.stream_dedup,
    "a4_fit": lambda s, d: Z.a4_fit(_literal(s, PAGES, "id long, width double, height double")),
    "crop_iou": lambda s, d: Z.crop_choice(_literal(s, BOXES, "id long, veto boolean, m struct<x:double,y:double,w:double,h:double>, f struct<x:double,y:double,w:double,h:double>")),
}

# --- SQL ---------------------------------------------------------------------------------------------------------


def _s(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "[" + ", ".join(map(_s, x)) + "]"
    if isinstance(x, tuple):
        return "{" + ", ".join(f"'{k}': {_s(v)}" for k, v in zip("xywh", x, strict=True)) + "}"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x)


def _values(rows: list, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_s, r)) + ')' for r in rows)}) v({names})"


def _pick(values: list, by: str = "doc_id") -> str:
    return f"({_s(values)})[({by} % {len(values)})::INT + 1]"


_REG = f"""r AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS checksum, {_pick(R.TITLES)} AS title, {_pick(R.CATEGORIES)} AS category, {_pick(R.SUBCATEGORIES)} AS subcategory, {_pick(R.DATES)} AS date,
{_pick(R.FILES)} AS original_filename, 'C:/raws/' || source || '/' || {_pick(R.FILES)} AS original_path, '["' || lang || '","' || source || '"]' AS tags, 'résumé' || chr(10) || lang AS summary, coalesce(text, '') || ' ' || {_pick(R.PHRASES)} AS raw_text,
{_pick(R.REFERENCES)} AS registre, CASE WHEN doc_id % 3 = 1 THEN '' ELSE 'D:/archive/' || source || '/' || {_pick(R.FILES)} END AS new_path, '# ' || {_pick(R.TITLES)} || chr(10) || chr(10) || coalesce(text, '') AS markdown_content, {_pick(R.EXPIRIES)} AS expiry_date, {_pick(R.AMOUNTS)} AS total_amount, {_pick(R.VATS)} AS vat_amount, {_pick(R.SIRENS)} AS siren, {_pick(R.IBANS)} AS iban,
{_pick(R.NAMES)} AS contact_name, {_pick(R.EMAILS)} AS contact_email, {_pick(R.PHONES)} AS contact_phone, {_pick(R.ADDRESSES)} AS contact_address, {_pick(R.SITES)} AS contact_website, {_pick(R.KINDS)} AS file_type, {_pick(R.STATUSES)} AS status, {_pick(R.STAMPS)} AS created_at, {_pick(R.STAMPS[::-1])} AS updated_at FROM documents)"""
_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_EXTENSION = "regexp_extract(regexp_extract({0}, '([^/\\\\]*)$', 1), '(?s)[^.].*?(\\.[^.]*)$', 1)"
_GENERAL = "coalesce(nullif(subcategory, ''), 'general')"


def _tr(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _kind(x: str) -> str:
    e = f"lower(trim({_EXTENSION.format(x)}))"
    return f"CASE WHEN {e} IN ('.png','.jpg','.jpeg','.webp','.bmp','.tiff') THEN 'IMAGE' WHEN {e} IN ('.txt','.md','.csv','.log','.json') THEN 'TEXT' WHEN {e} IN ('.docx','.doc') THEN 'WORD' WHEN {e} IN ('.xlsx','.xls') THEN 'EXCEL' ELSE 'PDF' END"


_KIND = f"coalesce(nullif(file_type, ''), {_kind('original_filename')})"


def _any(q: str, fields: str) -> str:
    return " OR ".join(f"contains(lower({f}), {_s(q)})" for f in fields.split())


_CSV = """array_to_string(list_transform([id::VARCHAR, checksum, title, category, subcategory, date, expiry_date, total_amount, vat_amount, siren, iban, contact_name, contact_email, contact_phone, contact_address, contact_website, registre, status, regexp_replace(summary, '\\r?\\n', ' ', 'g'), original_filename, coalesce(nullif(new_path, ''), original_path)], lambda x: '"' || replace(x, '"', '""') || '"'), ',')"""


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim(strip_accents({x}))), '[^a-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g')"


_EXTS = "(pdf|jpg|jpeg|png|webp|tiff|bmp|txt|docx|xlsx)"


def _forbid(x: str) -> str:
    raw = f"lower(trim(coalesce({x}, '')))"
    bare = f"regexp_replace({raw}, '[^a-z0-9]+', '', 'g')"
    return f"({bare} = '' OR {raw} IN ({_s(FORBID)[1:-1]}) OR {bare} IN ({_s(FORBID)[1:-1]}) OR regexp_matches({bare}, '^\\d+$') OR regexp_matches({raw}, '[._-]{_EXTS}$') OR regexp_matches({raw}, '^(\\d+|img\\d*|scan\\d*|photo\\d*|doc\\d*|file\\d*)[_.]?{_EXTS}$') OR regexp_matches({bare}, '^(anyscanner|camscanner|geniusscan|adobescan|tinyscanner|simplescan|docscanner)'))"


FORBID = "general other divers unknown none anyscanner camscanner geniusscan adobescan tinyscanner simplescan docscanner jpg jpeg png webp bmp tiff pdf txt docx xlsx".split()


def _generic(x: str) -> str:
    base = f"regexp_extract({x}, '([^/\\\\]*)$', 1)"
    stem = f"lower(trim(left({base}, length({base}) - length({_EXTENSION.format(x)}))))"
    shapes = [r"^\d+$", "^[a-f0-9]{16,64}", "[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", r"(_blocked\d*|_dup\d*|\(\d+\)|_copy\d*)$", r"^(qptmp|scan[-_]?\d*|doc[-_]?\d*|img[-_]?\d*|photo[-_]?\d*|file[-_]?\d*|tmp[-_]?\d*|temp[-_]?\d*|fileopen[-_]?\d*|untitled|non_nomme|recap)", r"^(invoice|facture|receipt|download|document|recap)[-_\s\(\d]+$", r"^\d{8,}[-_]"]
    return f"(length({stem}) <= 3 OR " + " OR ".join(f"regexp_matches({stem}, '{p}')" for p in shapes) + ")"


_WEIGHED = {"title": 10.0, "original_filename": 1.0, "original_path": 1.0, "new_path": 1.0, "registre": 1.0, "summary": 3.0, "category": 2.0, "subcategory": 2.0, "tags": 6.0, "raw_text": 0.5}


def _fts(q: P.Query, limit: int = 10) -> str:
    import re
    import unicodedata

    plain = lambda p: re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", p.lower()) if not unicodedata.combining(c)))
    names = list(dict.fromkeys(p for f in [*q.facets(), q.not_terms] for p in f))

    def tf(c: str, p: str) -> str:
        t = plain(p)
        return "len(list_filter(range(1, len({0}) + 1), lambda i: {1}))".format(f"t_{c}", " AND ".join(f"t_{c}[i + {j}] = {_s(w)}" for j, w in enumerate(t)))

    cols = list(_WEIGHED)
    toks = ", ".join(f"list_filter(regexp_split_to_array(strip_accents(lower({c})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t_{c}" for c in cols)
    counts = ", ".join(f"{tf(c, p)} AS f{i}_{c}" for i, p in enumerate(names) for c in cols)
    held = {p: "(" + " + ".join(f"f{i}_{c}" for c in cols) + " > 0)" for i, p in enumerate(names)}
    sums = ", ".join(f"count(*) FILTER (WHERE {held[p]}) AS n{i}" for i, p in enumerate(names))
    where = " AND ".join("(" + " OR ".join(held[p] for p in f) + ")" for f in q.facets()) + "".join(f" AND NOT {held[p]}" for p in q.not_terms)
    where += f" AND category = {_s(q.category)}" if q.category else ""
    where += f" AND date <> '' AND date >= {_s(q.date_from)}" if q.date_from else ""
    where += f" AND date <> '' AND date <= {_s(q.date_to)}" if q.date_to else ""
    parts = []
    for i, p in enumerate(names):
        if any(p in f for f in q.facets()):
            w = "(" + " + ".join(f"{_WEIGHED[c]} * f{i}_{c}" for c in cols) + ")"
            idf = f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END)"
            parts.append(f"{idf}::DOUBLE * {w}::DOUBLE * 2.2::DOUBLE / ({w}::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / a))")
    return f"""WITH {_REG}, t AS (SELECT id, category, subcategory, date, {toks} FROM r),
c AS (SELECT id, category, subcategory, date, ({" + ".join(f"len(t_{c})" for c in cols)})::DOUBLE AS d, {counts} FROM t), s AS (SELECT count(*)::DOUBLE AS n, avg(d) AS a, {sums} FROM c),
x AS (SELECT id, round(-({" + ".join(parts)}), 9) AS score FROM c, s WHERE {where})
SELECT row_number() OVER (ORDER BY score, id)::INT AS rank, id, score FROM (SELECT * FROM x ORDER BY score, id LIMIT {limit})"""


_TOKS = r"""list_filter(regexp_split_to_array(lower(message), '[\s\x{00A0},.;:!?/\\''"()\[\]]+'), lambda t: t <> '')"""
_ASKED = ["", " 2 derniers relevés 2023", " last 3", " trois factures 2019 2021", " single 1949", " 25 documents"]
_MSG = f"m AS (SELECT conv_id * 1000 + turn AS id, text || {_pick(_ASKED, '(conv_id + turn)')} AS message FROM conversations WHERE role = 'user')"
_STOPS = _s(P.STOPWORDS)
_COUNT_NOUN = r"\b(\d+)\s*(derniers?|dernieres?|fiches?|bulletins?|factures?|pay|slips?|statements?|relevés?|docs?|documents?)\b"


def _day(x: str) -> str:
    iso, fr, y = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{2})/(\d{2})/(\d{4})", r"\b(20\d{2})\b"
    p = lambda r, i: f"try_cast(regexp_extract({x}, '{r}', {i}) AS INT)"
    day = lambda a, b, c: f"(CASE WHEN {b} BETWEEN 1 AND 12 AND {c} BETWEEN 1 AND 31 THEN datediff('day', DATE '1970-01-01', make_date({a}, {b}, 1)) + {c} - 1 ELSE 0 END)"
    return f"(CASE WHEN regexp_matches({x}, '{iso}') THEN {day(p(iso, 1), p(iso, 2), p(iso, 3))} WHEN regexp_matches({x}, '{fr}') THEN {day(p(fr, 3), p(fr, 2), p(fr, 1))} WHEN regexp_matches({x}, '{y}') THEN {day(p(y, 1), '1', '1')} ELSE 0 END)::BIGINT"


def _points(message: str) -> str:
    import re

    low = message.lower().strip()
    words = [t for t in re.split(r"[\s,.;:!?/\\_-]+", low) if len(t) > 2]
    f = {c: f"lower({c})" for c in ("title", "original_filename", "subcategory", "category", "summary")}
    out = [f"CASE WHEN contains({_s(low)}, {f['category']}) AND length(category) > 2 THEN 10 ELSE 0 END", f"CASE WHEN contains({_s(low)}, {f['subcategory']}) AND length(subcategory) > 2 THEN 15 ELSE 0 END"]
    out += [f"CASE WHEN contains({f[c]}, {_s(w)}) THEN {n} ELSE 0 END" for w in words for c, n in (("title", 6), ("original_filename", 5), ("subcategory", 4), ("category", 3), ("summary", 2))]
    return "(" + " + ".join(out) + ")::BIGINT"


def _scored(message: str, most: int = 10, fallback: int = 5) -> str:
    return f"""WITH {_REG}, s AS (SELECT id, {_points(message)} AS score, {_day('date')} AS day FROM r), b AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, day DESC, id DESC LIMIT {most}),
n AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM b) ORDER BY day DESC, id DESC LIMIT {fallback}), u AS (SELECT * FROM b UNION ALL SELECT * FROM n)
SELECT row_number() OVER (ORDER BY score DESC, day DESC, id DESC)::INT AS rank, id, score, day FROM u"""


_CASES = ["", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "| a | b |\n| --- | --- |\n| 1 |\n| 1 | 2 | 3 |\ntext\n| x | y |", "a | b | c\n- x | y | z\n| p | q", "| | |\n| 1 | 2 |\n\n| 7 | 8 |\n| 9 | 9 |", "| a | b | c |\n|:--|---|--:|\n" + "| 1 | 2 |\n" * 6]
_TAB = f"tb AS (SELECT doc_id AS id, coalesce(text, '') || chr(10) || {_pick(_CASES)} AS text FROM documents), ln AS (SELECT id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) - 1 AS ln FROM tb)"
_NL = r"[^\n\r\x{2028}\x{2029}]"
_STRICT = rf"^\|(?:{_WS}*:?-{{2,}}:?{_WS}*\|)+{_WS}*$"
_PIPES = "(length({0}) - length(replace({0}, '|', '')))"
_SEPSQL = rf"^{_WS}*\|{_WS[:-1]}:|-]+\|{_WS}*$"
_CELLS = f"len(string_split(regexp_replace(regexp_replace({_tr('line')}, '^\\|', ''), '\\|$', ''), '|'))"
_BLOCKS = rf"""{_TAB}, rw AS (SELECT id, ln, ln - row_number() OVER (PARTITION BY id ORDER BY ln) AS g, {_CELLS} AS cells, regexp_matches(line, '{_SEPSQL}') AS sep FROM ln WHERE regexp_matches(line, '^{_WS}*\|{_NL}*\|{_WS}*$')),
bl AS (SELECT id, g, min(ln) AS start, min(ln) FILTER (WHERE sep) AS sep_at FROM rw GROUP BY id, g),
hd AS (SELECT b.*, (SELECT cells FROM rw WHERE rw.id = b.id AND rw.ln = CASE WHEN b.sep_at > b.start THEN b.sep_at - 1 ELSE b.sep_at END) AS header FROM bl b),
bk AS (SELECT h.id, h.start::BIGINT AS start, h.header::BIGINT AS header, count(*) FILTER (WHERE h.sep_at IS NOT NULL AND rw.ln <> h.sep_at AND rw.ln <> h.sep_at - 1) AS data_rows,
count(*) FILTER (WHERE h.sep_at IS NOT NULL AND rw.ln <> h.sep_at AND rw.ln <> h.sep_at - 1 AND rw.cells <> h.header) AS ragged, h.sep_at IS NOT NULL AS headed FROM hd h JOIN rw USING (id, g) GROUP BY ALL)"""
_AUDIT = f"""{_BLOCKS}, au AS (SELECT id, count(*) AS blocks, sum(data_rows)::BIGINT AS data_rows, sum(ragged)::BIGINT AS ragged, count(*) FILTER (WHERE NOT headed) AS headerless, arg_max(start, (ragged, -start)) FILTER (WHERE ragged > 0) AS worst_start FROM bk GROUP BY id)"""
_UNITS = _s(Q.UNITS)


def _corrupt(source: str) -> str:
    return f"""f AS (SELECT id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) BETWEEN 2 AND 8 AND NOT list_contains({_UNITS}, w)), lambda w: CASE WHEN length(regexp_replace(w, '[^\\p{{Lu}}]', '', 'g')) = 1 AND NOT regexp_matches(w, '^\\p{{Lu}}') THEN 1 ELSE 0 END) AS f FROM {source}),
w AS (SELECT id, s, len(f[s + 1 : s + 100]) AS n, coalesce(list_sum(f[s + 1 : s + 100]), 0) AS h FROM (SELECT id, f, unnest(range(0, greatest(len(f), 1), 50)) AS s FROM f) WHERE len(f) - s >= 60),
co AS (SELECT f.id, (SELECT count(*) FROM w WHERE w.id = f.id)::BIGINT AS windows, (SELECT {{'r': h / n, 's': -s, 'h': h}} FROM w WHERE w.id = f.id AND h >= 6 AND h / n >= 0.08 ORDER BY h / n DESC, s LIMIT 1) AS b FROM f)"""


_PROSE = """p AS (SELECT id, regexp_extract_all(text, '\\p{L}+') AS w FROM %s), ps AS (SELECT id, len(w)::BIGINT AS tokens, CASE WHEN len(w) = 0 THEN -1.0::DOUBLE ELSE round(list_sum(list_transform(w, lambda x: length(x))) / len(w) - 1.5::DOUBLE * (len(list_filter(w, lambda x: length(x) = 1)) / len(w)) - 0.4::DOUBLE * (len(list_filter(w, lambda x: length(x) <= 2)) / len(w)), 9) END AS score FROM p)"""
_MALFORMED = f"mf AS (SELECT id, count(*) FILTER (WHERE NOT regexp_matches(t, '^\\|{_NL}*\\|$') AND NOT regexp_matches(t, '{_STRICT}') AND {_PIPES.format('t')} >= 2)::BIGINT AS n FROM (SELECT id, {_tr('line')} AS t FROM ln) GROUP BY id)"


def _re(p: str) -> str:
    return p.replace("'", "''")


def _dates() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN " + " || '-' || ".join(f"regexp_extract(c, '{p}', {i})" for i in at) for p, at in C.DATES) + f" ELSE '{TODAY}' END"


_ENT = "CASE " + " ".join(f"WHEN regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){n}($|[^\\p{{L}}\\p{{N}}])') THEN {{'domain': '{d}', 'slug': '{s}'}}" for d, s, n in C.ENTITIES) + " END"
_CMP = "regexp_replace(strip_accents(lower({0})), '[^a-z0-9]', '', 'g')"
_TAX = f"tx AS (SELECT * FROM {_values([(i, *t) for i, t in enumerate(X.TAXONOMY)], 'ord, category, subcategory, aliases')})"
_DEC = f"dc AS (SELECT * FROM {_values(DECISIONS, 'id, original_filename, title, category, subcategory, enabled')})"
_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^\\d+$') AND NOT list_contains(" + _s(STOP) + ", strip_accents(t)))"
_KEYS = f"""wd AS (SELECT *, {_WORDS.format("regexp_replace(original_filename, '\\.[^.]*$', '')")} AS a, {_WORDS.format("title")} AS b FROM dc), ev AS (SELECT *, list_concat(a, b) AS e FROM wd),
ds AS (SELECT *, list_filter(e, lambda t, i: list_position(e, t) = i) AS u FROM ev),
kw AS (SELECT * EXCLUDE (a, b, e, u), array_to_string(list_concat(list_filter(u, lambda t: list_contains(a, t) AND list_contains(b, t)), list_filter(u, lambda t: NOT (list_contains(a, t) AND list_contains(b, t))))[1:3], ',') AS keywords FROM ds)"""
_DAY = r"\b(20\d{2})[-/._]?(\d{2})[-/._]?(\d{2})\b"
_SEG = "regexp_replace({0}, '^[_.-]+|[_.-]+$', '', 'g')"
_LOGS = "lg AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, user_id AS filename, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' ELSE '' END AS status, CASE WHEN value > 50 THEN event_type ELSE '' END AS reason FROM events)"
_SESSIONS = f"""WITH {_LOGS} SELECT filename, arg_min(stamp, event_id) AS first, arg_max(stamp, event_id) AS last, count(*) AS n, CASE WHEN count(*) FILTER (WHERE status = 'FAILED') > 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE status = 'COMPLETED') > 0 THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS status,
coalesce(arg_max(reason, event_id) FILTER (WHERE reason <> ''), '') AS reason FROM lg GROUP BY filename"""

ORACLE_SQL = {
    "fts_bm25_topk": _fts(FACETS),
    "fts_not": _fts(NEGATED),
    "fts_index_topk": _fts(FACETS),
    "fts_index_not": _fts(NEGATED),
    "fts_filtered": _fts(FILTERED),
    "fts_relax_ladder": "SELECT min(rung) OVER ()::INT AS rung, rank, id, score FROM (" + " UNION ALL ".join(f"SELECT {i} AS rung, * FROM ({_fts(q)})" for i, q in enumerate(LADDER.ladder())) + ") QUALIFY rung = min(rung) OVER ()",
    "plan_heuristic": f"""WITH {_MSG}, k AS (SELECT id, {_TOKS} AS w FROM m), y AS (SELECT id, list_filter(w, lambda t: NOT regexp_matches(t, '^(19[5-9]\\d|20\\d\\d|2100)$') AND length(t) > 2 AND NOT list_contains({_STOPS}, t)) AS k, list_filter(w, lambda t: regexp_matches(t, '^(19[5-9]\\d|20\\d\\d|2100)$'))[-1] AS y FROM k)
SELECT id, array_to_string(k, ' ') AS keywords, len(k)::BIGINT AS n_keywords, y || '-01-01' AS date_from, y || '-12-31' AS date_to FROM y""",
    "requested_count": f"""WITH {_MSG}, l AS (SELECT id, lower(message) AS s FROM m), n AS (SELECT id, s, try_cast(regexp_extract(s, '{_COUNT_NOUN}', 1) AS INT) AS n FROM l)
SELECT id, CASE WHEN n BETWEEN 1 AND 20 THEN n WHEN regexp_matches(s, '\\b(trois|three)\\b') THEN 3 WHEN regexp_matches(s, '\\b(deux|two)\\b') THEN 2 WHEN regexp_matches(s, '\\b(single|last|dernier|dernière)\\b') THEN 1 END::INT AS n FROM n""",
    "token_scorer": _scored(MESSAGE, 2, 2),
    "token_scorer_fallback": _scored("zzqx"),
    "prepare_dossier": _scored("quittance housing"),
    "doc_date_parse": f"WITH {_REG} SELECT id, {_day('date')} AS day FROM r",
    "payslip_dedupe": f"""WITH {_REG}, k AS (SELECT id, category, date, CASE WHEN lower(category) <> 'bulletin_salaire' THEN '#' || id WHEN {_day('date')} = 0 THEN '?' || id ELSE strftime(DATE '1970-01-01' + {_day('date')}::INT, '%Y-%m') END AS k FROM r) SELECT id, category, date FROM k QUALIFY id = max(id) OVER (PARTITION BY k)""",
    "citation_prune": f"""WITH a AS (SELECT * FROM {_values(ANSWERS, 'id, answer, ids, asked')}), c AS (SELECT id, ids, asked, list_transform(regexp_extract_all(answer, '(?i)\\[doc #(\\d+)', 1), lambda y: y::INT) AS said FROM a), k AS (SELECT *, list_filter(ids, lambda x: list_contains(said, x)) AS k FROM c)
SELECT id::BIGINT AS id, unnest(CASE WHEN len(said) > 0 AND len(k) >= CASE WHEN asked IS NULL THEN (len(ids) + 1) // 2 WHEN asked < len(ids) THEN asked ELSE len(ids) END THEN k ELSE ids END)::BIGINT AS doc_id FROM k""",
    "registry_list": f"""WITH {_REG} SELECT id, checksum, title, registre, date, category, {_GENERAL} AS subcategory, summary, array_to_string(json_transform(tags, '["VARCHAR"]'), ',') AS tags, left(raw_text, 800) AS raw_text, markdown_content, total_amount, vat_amount, siren, iban, expiry_date, contact_name, contact_email, contact_phone, contact_address, contact_website, original_filename, original_path, new_path, status, created_at, updated_at
FROM r WHERE lower(category) = 'invoices' AND ({_any('sfr', 'original_path new_path title original_filename summary registre subcategory contact_name contact_email tags raw_text')})""",
    "registry_list_subcategory": f"WITH {_REG} SELECT id, subcategory FROM r WHERE lower(subcategory) = 'sfr'",
    "registry_lookup": f"WITH {_REG} SELECT id, title, checksum FROM r WHERE id = 7 UNION ALL (SELECT id, title, checksum FROM r WHERE checksum = sha256('') ORDER BY id LIMIT 1)",
    "tool_search": f"""WITH {_REG}, f AS (SELECT id, title, registre, date, category, subcategory, {_KIND} AS file_type, summary, new_path, status FROM r WHERE upper({_KIND}) = 'PDF' AND ({_any('santé', 'title summary registre tags subcategory raw_text')}) ORDER BY id DESC LIMIT 20) SELECT *, count(*) OVER () AS count FROM f""",
    "tool_search_tail": f"""WITH {_REG}, f AS (SELECT id, title, registre, date, category, subcategory, {_KIND} AS file_type, summary, new_path, status FROM r WHERE lower(category) = 'bank' AND ({_any('17 b', 'title summary registre tags subcategory raw_text')}) QUALIFY row_number() OVER (ORDER BY id) > 3) SELECT *, count(*) OVER () AS count FROM f""",
    "registry_csv_line": f"WITH {_REG} SELECT id, {_CSV} AS line FROM r",
    "registry_csv_filtered": f"WITH {_REG} SELECT id, {_CSV} AS line FROM r WHERE lower(category) = 'bank' AND ({_any('sfr', 'title original_filename summary registre subcategory contact_name contact_email tags')})",
    "registry_json_line": f"""WITH {_REG} SELECT id, to_json({{'id': id, 'checksum': checksum, 'title': title, 'registre': registre, 'date': date, 'category': category, 'subcategory': {_GENERAL}, 'summary': summary, 'tags': json_transform(tags, '["VARCHAR"]'), 'original_filename': original_filename, 'original_path': original_path, 'new_path': new_path, 'status': status, 'created_at': created_at, 'updated_at': updated_at}})::VARCHAR AS line FROM r""",
    "insert_defaults": f"""WITH {_REG} SELECT id, {_GENERAL} AS subcategory, {_KIND} AS file_type, CASE WHEN id % 3 = 1 THEN status ELSE 'PENDING' END AS status, CASE WHEN id % 2 = 0 THEN tags ELSE '[]' END AS tags, '[]' AS embedding, original_filename, CASE WHEN id % 5 > 0 THEN title ELSE '' END AS title FROM r""",
    "category_stats": f"""WITH {_REG}, k AS (SELECT translate(category, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS category, translate({_GENERAL}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS subcategory FROM r) SELECT category, subcategory, count(*) AS n FROM k GROUP BY ROLLUP (category, subcategory)""",
    "category_tree_counts": f"""WITH {_REG}, {_TAX}, k AS (SELECT translate(category, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS category, translate({_GENERAL}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS subcategory, count(*) AS n FROM r GROUP BY ALL)
SELECT category, subcategory, coalesce(k.n, 0) AS n, true AS configured FROM tx LEFT JOIN k USING (category, subcategory) UNION ALL SELECT category, subcategory, n, false FROM k ANTI JOIN tx USING (category, subcategory) WHERE subcategory <> 'general' AND NOT regexp_matches(subcategory, '^\\d{{4}}$')""",
    "checksum_dedup": f"WITH {_REG} SELECT checksum, min(id) AS id, count(*) AS copies FROM r WHERE id % 10 <> 0 AND checksum NOT IN (SELECT checksum FROM r WHERE id % 10 = 0) GROUP BY checksum",
    "blocked_skip": f"WITH {_REG} SELECT original_path, count(*) AS n FROM r WHERE (original_path, id % 50, id % 7) NOT IN (SELECT (original_path, id % 50, id % 7) FROM r WHERE id % 5 = 0) GROUP BY original_path",
    "partial_update": f"WITH {_REG} SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'new' WHEN id % 3 = 0 AND id % 4 < 3 THEN 'nouveau' ELSE title END AS title, CASE WHEN id % 15 = 0 THEN '' ELSE subcategory END AS subcategory FROM r",
    "collision_names": f"WITH {_REG} SELECT id, title AS name, CASE WHEN id = max(id) OVER (PARTITION BY title) THEN title ELSE title || '_' || id END AS unique_name FROM r",
    "clean_text": f"""WITH {_REG}, t AS (SELECT id, ' ' || chr(13) || chr(10) || chr(10) || chr(10) || replace(raw_text, '. ', '.' || chr(13) || chr(10) || chr(13) || chr(10) || chr(10)) AS t FROM r), u AS (SELECT id, CASE WHEN strlen(regexp_replace(t, '^[\\s\\x{{85}}\\x{{A0}}]+|[\\s\\x{{85}}\\x{{A0}}]+$', '', 'g')) < 10 THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\x{{85}}\\x{{A0}}]+|[\\s\\x{{85}}\\x{{A0}}]+$', '', 'g') END AS t FROM t)
SELECT id, length(t)::BIGINT AS chars, md5(t) AS md5 FROM u""",
    "no_text_block": f"SELECT doc_id AS id, length({_tr('text')}) < 10 AS blocked FROM documents",
    "prose_score": f"WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {_PROSE % 'd'} SELECT id, tokens, score FROM ps",
    "corruption_windows": f"WITH mg AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'th', 'tH') ELSE text END AS text FROM documents), {_corrupt('mg')} SELECT id, windows, round(coalesce(b.r, 0.0::DOUBLE), 9) AS ratio, coalesce(b.h, 0)::BIGINT AS matches, b IS NOT NULL AS corrupted FROM co",
    "thin_layer": r"""WITH d AS (SELECT doc_id AS id, regexp_replace(CASE WHEN doc_id % 9 = 0 THEN 'watermark' || chr(10) || 'watermark' || chr(10) || 'watermark' ELSE text END, '^\s+|\s+$', '', 'g') AS t, greatest(doc_id % 5 * 4, 1) AS p FROM documents),
l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS l, len(list_distinct(regexp_extract_all(lower(t), '[a-zà-ÿ]{3,}'))) AS w FROM d),
c AS (SELECT id, p >= 2 AND t <> '' AND len(l) >= p AND len(list_distinct(l)) <= 2 AND coalesce(list_sum(list_transform(list_distinct(l), lambda x: length(x))), 0) <= 200 AS a, p >= 2 AND t <> '' AND length(t) / p < 100 AND w / p < 10 AS b FROM l)
SELECT id, a OR b AS thin, CASE WHEN a THEN 'repeated-boilerplate' WHEN b THEN 'low-density' ELSE '' END AS reason FROM c""",
    "content_recall": f"""WITH {_REG}, d AS (SELECT id, list_distinct(regexp_extract_all(lower(raw_text), '[a-zà-ÿ]{{6,}}|\\d[\\d.,]{{2,}}')) AS o, regexp_extract_all(lower(CASE WHEN id % 2 = 0 THEN regexp_replace(raw_text, '[a-zà-ÿ]*[eo]n[a-zà-ÿ]*', 'x', 'g') ELSE raw_text END), '[a-zà-ÿ]{{6,}}|\\d[\\d.,]{{2,}}') AS k, list_filter(regexp_split_to_array({_tr('raw_text')}, '{_WS}+'), lambda w: w <> '') AS w, length({_tr('raw_text')}) AS c FROM r),
e AS (SELECT id, len(o) AS n, len(list_filter(o, lambda t: NOT list_contains(k, t) AND length(t) < 15 AND length(t) - length(replace(t, ',', '')) < 2)) AS m, c / greatest(len(w), 1) >= 25 OR len(list_filter(w, lambda x: length(x) >= 15)) / greatest(len(w), 1) >= 0.35 OR len(list_filter(w, lambda x: regexp_matches(x, '[a-zà-ÿ][A-ZÀ-Ý]'))) / greatest(len(w), 1) >= 0.05 AS f FROM d)
SELECT id, n::BIGINT AS total, m::BIGINT AS missing, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE round((n - m) / n, 9) END AS recall, n >= 40 AND NOT f AS measurable FROM e""",
    "malformed_pipes": f"WITH {_TAB}, {_MALFORMED} SELECT id, n FROM mf",
    "md_edge_pipes": f"""WITH {_TAB}, t AS (SELECT id, ln, line, {_tr('line')} AS t FROM ln) SELECT id, md5(string_agg(CASE WHEN t <> '' AND NOT regexp_matches(t, '^\\|{_NL}*\\|{_WS}*$') AND NOT regexp_matches(t, '{_STRICT}') AND NOT regexp_matches(t, '^[>#*+\\-]|^\\d+\\.') AND {_PIPES.format('t')} >= 2 THEN (CASE WHEN starts_with(t, '|') THEN '' ELSE '| ' END) || t || (CASE WHEN ends_with(t, '|') THEN '' ELSE ' |' END) ELSE line END, chr(10) ORDER BY ln)) AS md5 FROM t GROUP BY id""",
    "md_table_audit": f"WITH {_AUDIT} SELECT * FROM au",
    "md_table_blocks": f"WITH {_BLOCKS} SELECT * FROM bk",
    "scalar_functions": f"""WITH {_REG} SELECT id, {_slug('category')} AS slug, strip_accents(summary) AS folded, {_kind('original_filename')} AS file_type, {_forbid('subcategory')} AS forbidden, {_generic('original_filename')} AS generic, round(1 - levenshtein({_slug('category')}, 'invoice') / greatest(length({_slug('category')}), 7), 9) AS similarity FROM r""",
    "entity_match": f"WITH {_REG}, e AS (SELECT id, lower(raw_text) AS low FROM r), f AS (SELECT id, {_ENT} AS e FROM e) SELECT id, e.domain AS domain, e.slug AS slug FROM f WHERE e IS NOT NULL",
    "priority_override": f"""WITH {_REG}, e AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'other' ELSE category END AS category, subcategory, lower(raw_text) AS low FROM r), f AS (SELECT *, {_ENT} AS e FROM e), g AS (SELECT *, coalesce((e.domain = 'banks' AND category <> 'bank') OR (e.domain <> 'banks' AND category IN ('correspondence', 'other', 'personal', '')), false) AS h FROM f)
SELECT id, CASE WHEN NOT h THEN category WHEN e.domain = 'banks' THEN 'bank' WHEN e.domain IN ('energy', 'telecom') THEN 'invoices' WHEN e.domain = 'gov' THEN 'administrative' ELSE e.domain END AS category, CASE WHEN h THEN e.slug ELSE subcategory END AS subcategory, CASE WHEN h THEN 'override' ELSE 'kept' END AS reason FROM g""",
    "subcategory_conflict": f"""WITH {_TAX}, p AS (SELECT category, subcategory, {_CMP.format('subcategory')} AS s FROM {_values(PROPOSED, 'category, subcategory')}), n AS (SELECT ord, category AS tc, subcategory AS ts, 0 AS al, {_CMP.format('subcategory')} AS t FROM tx UNION ALL SELECT ord, category, subcategory, 1, {_CMP.format('a')} FROM (SELECT ord, category, subcategory, unnest(aliases) AS a FROM tx)),
m AS (SELECT *, CASE WHEN s = t THEN 1.0 ELSE 1 - levenshtein(s, t) / greatest(length(s), length(t)) END AS r FROM p, n), k AS (SELECT *, CASE WHEN s = t AND al = 0 THEN 0 WHEN s = t THEN 1 WHEN r >= 0.82 AND length(s) >= 4 AND length(t) >= 4 THEN 2 END AS rk, s = t AND al = 0 AND category = tc AS own FROM m),
q AS (SELECT *, bool_or(own) OVER (PARTITION BY category, subcategory) AS known FROM k WHERE rk IS NOT NULL)
SELECT category, subcategory, CASE rk WHEN 0 THEN 'cross-category' WHEN 1 THEN 'alias' ELSE 'near' END AS kind, tc AS to_category, ts AS to_subcategory, round(r * 100)::BIGINT AS percent FROM q WHERE NOT known QUALIFY row_number() OVER (PARTITION BY category, subcategory ORDER BY rk, r DESC, ord) = 1""",
    "canonical_owner": f"WITH {_TAX}, o AS (SELECT subcategory, list(DISTINCT category) AS o FROM tx GROUP BY subcategory) SELECT p.category, p.subcategory, CASE WHEN list_contains(o, p.category) THEN p.category WHEN len(o) = 1 THEN o[1] END AS owner FROM {_values(OWNED, 'category, subcategory').replace(' v(', ' p(')} LEFT JOIN o USING (subcategory)",
    "taxonomy_merge": f"WITH {_TAX}, m AS (SELECT category, CASE WHEN category = 'invoices' AND subcategory = 'bouygues_telecom' THEN 'sfr' ELSE subcategory END AS s, CASE WHEN category = 'invoices' AND subcategory = 'bouygues_telecom' THEN list_append(aliases, subcategory) ELSE aliases END AS a FROM tx) SELECT category, s AS subcategory, coalesce(array_to_string(list_sort(list_distinct(flatten(list(a)))), ','), '') AS aliases FROM m GROUP BY category, s",
    "derive_keywords": f"WITH {_DEC}, {_KEYS} SELECT id::BIGINT AS id, coalesce(keywords, '') AS keywords FROM kw",
    "priority_rules": f"WITH {_DEC}, {_KEYS} SELECT row_number() OVER (ORDER BY id DESC)::INT AS ord, id::BIGINT AS id, category, subcategory, keywords FROM kw WHERE coalesce(enabled, 1) <> 0 AND trim(category) <> '' AND NOT {_forbid('subcategory')} AND coalesce(keywords, '') <> ''",
    "canonical_path": f"""WITH {_REG}, a AS (SELECT id, title, original_filename, {_SEG.format(_slug('category'))} AS cat, {_SEG.format(_slug("CASE WHEN regexp_matches(subcategory, '^\\d{4}$') OR subcategory = '' THEN 'general' ELSE subcategory END"))} AS sub, CASE WHEN {_forbid('subcategory')} THEN lower(trim(category)) ELSE lower(trim(subcategory)) END AS e,
coalesce(nullif(regexp_extract(date, '\\b(20\\d{{2}})\\b', 1), ''), '{TODAY[:4]}') AS y, CASE WHEN regexp_matches(date, '{_DAY}') THEN regexp_extract(date, '{_DAY}', 1) || '-' || regexp_extract(date, '{_DAY}', 2) || '-' || regexp_extract(date, '{_DAY}', 3) ELSE coalesce(nullif(regexp_extract(date, '\\b(20\\d{{2}})\\b', 1), ''), '{TODAY}') END AS day,
list_filter(regexp_split_to_array(trim(regexp_replace(strip_accents(title), '[^a-zA-Z0-9\\s_-]', '', 'g')), '[/\\\\_\\s-]+'), lambda w: w <> '') AS w FROM r),
b AS (SELECT *, array_to_string(list_transform(list_filter(regexp_split_to_array(e, '[/\\\\_\\s-]+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), '') AS en FROM a),
c AS (SELECT *, list_filter(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), lambda x: NOT contains(day, lower(x)) AND NOT contains(lower(en), lower(x))) AS k FROM b)
SELECT id, 'root/' || cat || '/' || sub || '/' || y || '/' || CASE WHEN trim(title) <> '' AND {_generic('original_filename')} THEN day || '_' || en || '_' || left(CASE WHEN len(k) = 0 THEN 'Document' ELSE array_to_string(k, '_') END, 45) || lower(coalesce(nullif({_EXTENSION.format('original_filename')}, ''), '.pdf')) ELSE original_filename END AS path FROM c""",
    "log_sessions": _SESSIONS,
    "stream_log_sessions": _SESSIONS,
    "recent_ring": f"WITH {_LOGS} SELECT event_id, stamp, filename FROM lg ORDER BY event_id DESC LIMIT 1000",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS i FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, event_id, t, i FROM e WHERE i = 1 UNION ALL SELECT n.user_id, n.e.event_id, n.e.t, n.e.i FROM (SELECT r.user_id, min({'i': e.i, 'event_id': e.event_id, 't': e.t}) AS e FROM r JOIN e ON e.user_id = r.user_id AND e.i > r.i AND e.t - r.t >= 86400 GROUP BY r.user_id, r.i) n)
SELECT user_id, event_id FROM r""",
    "a4_fit": f"""WITH i AS (SELECT id::BIGINT AS id, width::DOUBLE AS w, height::DOUBLE AS h FROM {_values(PAGES, 'id, width, height')}), p AS (SELECT *, w > 0 AND h > 0 AS ok, CASE WHEN w > 0 AND h > 0 AND w > h THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS pw, CASE WHEN w > 0 AND h > 0 AND w > h THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS ph FROM i), s AS (SELECT *, CASE WHEN ok THEN w * least(pw / w, ph / h) ELSE pw END AS dw, CASE WHEN ok THEN h * least(pw / w, ph / h) ELSE ph END AS dh FROM p)
SELECT id, pw AS page_width, ph AS page_height, round(dw, 6) AS draw_width, round(dh, 6) AS draw_height, round((pw - dw) / 2, 6) AS x, round((ph - dh) / 2, 6) AS y FROM s""",
    "crop_iou": f"""WITH b AS (SELECT * FROM {_values(BOXES, 'id, veto, m, f')}), o AS (SELECT *, greatest(0, least(m.x + m.w, f.x + f.w) - greatest(m.x, f.x)) * greatest(0, least(m.y + m.h, f.y + f.h) - greatest(m.y, f.y)) AS i FROM b), u AS (SELECT *, CASE WHEN m IS NULL OR f IS NULL THEN 0.0::DOUBLE ELSE (i / (m.w * m.h + f.w * f.h - i))::DOUBLE END AS iou FROM o)
SELECT id::BIGINT AS id, CASE WHEN veto THEN 'veto' WHEN f IS NULL AND m IS NULL THEN 'none' WHEN f IS NULL THEN 'model' WHEN m IS NULL OR iou < 0.5 THEN 'flood' ELSE 'agree' END AS source, round(iou, 9) AS iou FROM u""",
}
