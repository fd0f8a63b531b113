"""The queries over files, paths, repairs of tables and changes of the taxonomy, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import paths as N
from quarry.operators import classify as C
from quarry.operators import repairs as M
from quarry.operators import taxonomy as X
from quarry.queries import _CMP, _GENERAL, _NL, _REG, _SEPSQL, _STRICT, _TAX, _WS, TODAY, _corrupt, _forbid, _kind, _pick, _s, _slug, _tr, _values
from quarry.queries import ORACLE_SQL as BASE_SQL
from quarry.sources import files as S
from quarry.sources.registry import dealt, registry
from quarry.streaming import events as Z

DIRS = ["raws/a", "raws/.hidden", "raws/duplicates/x", "raws/blocked_files", "raws/scans", "raws/scans/deep", "raws/Ignored/deep", "raws/ignoredness", "out/a", "raws"]
EXTS = [".pdf", ".PNG", ".jpg", ".exe", "", ".tar.gz", ".md", ".xlsx"]
PICTURES = [".png", ".jpg"]
#: Texts with tables: a wide one, continuations that merge and that don't, edge pipes, noise.
WIDE = "| " + " | ".join(str(i) for i in range(15)) + " |"
TABLES = [
    "", "| a | b |\n|---|---|\n| 1 | 2 |\n\n \n| 3 | 4 |\nend", "| a | b |\n|---|---|\n| 1 | 2 |\nx\n| 3 | 4 |", WIDE + "\n|" + "---|" * 15 + "\n" + WIDE + "\n\n| 1 | 2 |", "| a |\n|---|\n\n| 3 |\n\n| 4 |",
    "a | b | c\n| x | y\n" + "é | " * 40, "| a | b |\n|---|---|\n\n| 1 | 2 | 3 |\n\n| p | q |\n| - | - |\n| r | s |", "[Propriétés Document: x]  \nQPtmp12 y \t\nchrome-extension___ab_1\n\n\n\nz[OCR Extracted Text]\n[ocr extracted text] a",
]
NAMES = ["C:\\raws\\Été \"x\".pdf", " /mnt/c:/a/b ", "/mnt/D/x/y", "d:/", "a_b__C dÉ", "100% 'vrai' (1)!~*.txt", "plan/de?vol|<b>", "page10.jpg", "Page9.jpg", "page09b2.jpg", "😀é.pdf", "", "/mnt/c", "raws/Ignored", "raws/ignored/z", "raws/ignoredness"]
NUMBERS = ["12", " 3.9x", "-7", "+8a", "", "x1", "9007199254740992", "1.0", "2.5", "99999999999999999999", "0", "1e3"]
SIZES = [0, 1, 1023, 1024, 1536, 1029, 10240, 1048575, 1048576, 5368709120, 1099511627776, 2251799813685248, 131, 1285]
DATED = [("2026-12-05", "Facture 2025"), ("05/12/2026", "Avis 2024 et 2023"), ("05.12.26", "x2025"), ("2026-01-15", "2025"), ("2026-12-31", "2026"), ("2027-02-30", "2026"), ("2026-13-40", "en 2024"), ("bientôt", "2024"), (None, None), ("2030-05-05", "2029"), (" 2026-11-05 ", "2025")]
REFINED = [("personal", "x", "bank", "bnp", "a.pdf"), ("correspondence", "general", "administrative", "impot", "Avis_IMPOT.pdf"), ("correspondence", "sfr", "administrative", "impot", "a.pdf"), ("bulletin_salaire", "general", "bank", "general", "a"), ("other", "general", "invoices", "edf", "tax"), ("invoices", "general", "", "edf", "b"), ("bank", "bnp", "x", "y", "z"), ("correspondence", "general", "health", "ameli", "q")]
CATEGORY_NAMES = ["invoice", "Invoicess", "invoices", "sfr", "boursorama", "boursobanque", "housingg", "tax", "foncia", "edf", "", "general", "Red by SFR box", "hea lth", "Bnp"]
CHANGED = [("bank", "bnp", "Bank", "BNP"), ("bank", "bnp", "bank", "lcl"), ("", "", "x", ""), (None, "a", "", "a"), ("a", "b", "c", "b")]
EDITS = [(1, "general"), (2, "2023"), (3, None), (-5, "sfr"), (-6, "pdf"), (7, "edf")]
TURNS = [(1, 6, 90), (2, 3, 90), (3, None, 0), (4, 1, 0), (5, 8, 270), (6, 2, 0)]
IDS = [5, 3, -1, 12, 5]
PUBLIC = [("invoices", "sfr"), ("bank", "bnp"), ("bank", "general")]
PRIVATE = [("invoices", "sfr"), ("invoices", "free"), ("travel", "sncf"), ("travel", "scan_1.pdf"), ("travel", "sncf")]
KNOWN = [("invoices", ["facture", "invoice"]), ("housing", ["logement"]), ("bank", ["Relevé"]), ("administrative", [])]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, size, checksum, id): a file for each document, dealt over folders by id."""
    i = F.col("doc_id")
    where = dealt(DIRS, i)
    ext = F.when(where.startswith("raws/scans"), dealt(PICTURES, i)).otherwise(dealt(EXTS, F.floor(i / 3)))
    return _docs(spark, sf_dir).select(F.concat(where, F.lit("/p"), i.cast("string"), ext).alias("path"), F.coalesce("n_chars", F.lit(0)).alias("size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"), i.alias("id"))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return _docs(spark, sf_dir).select(i.alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), dealt(TABLES, i)).alias("text"))


def _rows(spark: SparkSession, values: list, names: str) -> DataFrame:
    """Literal values, numbered from 1 as id."""
    return spark.createDataFrame([(n, *(v if isinstance(v, tuple) else (v,))) for n, v in enumerate(values, 1)], f"id long, {names}")


def _hashed(df: DataFrame) -> DataFrame:
    return df.select("id", F.md5("text").alias("md5"), "blocks")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _rows(spark, NAMES, "x string").select(
        "id", N.to_mount(x).alias("mount"), N.to_drive(x).alias("drive"), N.title_of_slug(x).alias("title"), N.capitalised(x).alias("capital"), N.safe_title(x).alias("safe"), N.safe_entry(x).alias("entry"),
        N.uri_component(x).alias("uri"), N.attachment(x).alias("header"), N.supported(x).alias("supported"), N.inside(x, "RAWS\\ignored/").alias("inside"),
    )


def _ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tree(spark, sf_dir)
    rows = files.where("id % 4 <> 1").select("id", "checksum", F.when(F.col("id") % 3 == 0, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("new_path"))
    return S.reconciled(rows, files.where("id % 5 <> 2").select("checksum", "path"))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tree(spark, sf_dir)
    i = F.col("id")
    name = F.when(i % 6 == 0, "").otherwise(F.upper(N.base_name(F.col("path"))))
    rows = files.select("id", F.when(i % 3 == 0, F.col("path")).otherwise("").alias("new_path"), F.when(i % 4 == 0, F.col("path")).otherwise(F.concat(F.lit("gone/"), N.base_name(F.col("path")))).alias("original_path"), name.alias("original_filename"))
    return S.located(rows, files.where("id % 7 <> 3"), "raws/a")


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Z.progress(e.select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, 200).otherwise(0).alias("total"), F.floor("value").alias("processed")))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select((F.col("user_id") % 5).alias("image"), F.least(F.lit(255), F.floor(F.col("value")) + (F.col("user_id") % 5) * 20).cast("int").alias("grey"))


def _extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    bad = F.replace(text, F.lit("th"), F.lit("tH"))
    return _docs(spark, sf_dir).select(i.alias("id"), F.when(i % 3 == 0, text).otherwise(bad).alias("digital"), F.when(i % 5 == 0, "court").when(i % 5 == 1, bad).when(i % 5 == 2, "a b c d e f g h i j k l").otherwise(text).alias("ocr"))


def _registry(f):
    return lambda s, d: f(registry(s, d))


QUERIES = {
    "file_scan": lambda s, d: S.scan(tree(s, d), "raws", "raws/ignored").select("path", "size"),
    "file_scan_all": lambda s, d: S.scan_all(tree(s, d)).select("path", "size"),
    "directory_stats": lambda s, d: S.directory_stats(tree(s, d)),
    "image_bundles": lambda s, d: S.image_bundles(tree(s, d), "raws"),
    "registry_reconcile": _ghosts,
    "file_locate": _located,
    "package_ids": _registry(lambda d: S.packaged(d, IDS)),
    "path_functions": _names,
    "number_functions": lambda s, d: _rows(s, NUMBERS, "x string").select("id", N.whole_number(F.col("x")).alias("whole"), N.row_id(F.col("x")).alias("row_id")),
    "human_size": lambda s, d: _rows(s, SIZES, "x long").select("id", N.human_size(F.col("x")).alias("text")),
    "natural_order": lambda s, d: _rows(s, NAMES, "x string").select("id", "x", F.row_number().over(Window.orderBy(N.natural_key(F.col("x")), "id")).alias("place")),
    "md_neutralise": lambda s, d: _hashed(M.neutralised(_tables(s, d))),
    "md_merge_blocks": lambda s, d: _hashed(M.merged(_tables(s, d))),
    "chunk_screen": lambda s, d: M.screened(_tables(s, d)),
    "noise_removal": lambda s, d: _tables(s, d).select("id", F.md5(M.without_noise(F.col("text"))).alias("md5")),
    "extraction_choice": lambda s, d: M.best_extraction(_extractions(s, d)),
    "text_refresh": lambda s, d: _extractions(s, d).select("id", M.refreshed(F.col("ocr"), F.col("digital")).alias("refresh")),
    "date_reconcile": lambda s, d: C.reconciled_date(_rows(s, DATED, "date string, title string"), TODAY),
    "refine_classification": lambda s, d: C.refined(_rows(s, REFINED, "category string, subcategory string, rule_category string, rule_subcategory string, original_filename string")),
    "edit_guards": lambda s, d: C.guarded(s.createDataFrame(EDITS, "id long, subcategory string"), registry(s, d)),
    "category_conflict": lambda s, d: X.category_conflicts(_rows(s, CATEGORY_NAMES, "category string"), X.taxonomy(s)),
    "resolve_category": lambda s, d: X.resolve_categories(_rows(s, CATEGORY_NAMES, "category string"), KNOWN, X.taxonomy(s)),
    "overlay_merge": lambda s, d: X.merge_overlay(s.createDataFrame(PUBLIC, "category string, subcategory string"), s.createDataFrame(PRIVATE, "category string, subcategory string")),
    "overlay_diff": lambda s, d: X.overlay_diff(s.createDataFrame(PRIVATE, "category string, subcategory string"), s.createDataFrame(PUBLIC, "category string, subcategory string")),
    "ensure_categories": _registry(lambda d: X.ensure_categories(X.taxonomy(d.sparkSession), d)),
    "decision_changes": lambda s, d: X.changed_decisions(_rows(s, CHANGED, "old_category string, old_subcategory string, new_category string, new_subcategory string")).select("id"),
    "subcategory_rename": _registry(lambda d: X.renamed(d, "invoices", "sfr", "sfr_red")),
    "move_plan": _registry(lambda d: X.moves(d.withColumn("new_path", F.when(F.col("id") % 2 == 0, F.concat(F.lit("ROOT//invoices/sfr/2024/"), F.col("original_filename"))).otherwise("")), "root", TODAY)),
    "duplicate_names": _registry(lambda d: X.numbered(d.select("id", F.col("original_filename").alias("name")), "dup")),
    "task_progress": _updates,
    "auto_levels": lambda s, d: Z.levels(_pixels(s, d), 0.01),
    "upper_median": lambda s, d: Z.upper_median(_pixels(s, d), "image", "grey"),
    "orientation": lambda s, d: Z.orientation(s.createDataFrame(TURNS, "id long, tag int, model int")),
}

# --- SQL ---------------------------------------------------------------------------------------------------------


def _num(values: list, names: str) -> str:
    return _values([(n, *(v if isinstance(v, tuple) else (v,))) for n, v in enumerate(values, 1)], f"id, {names}")


_DIR = _pick(DIRS)
_TREE = f"tr AS (SELECT doc_id AS id, {_DIR} || '/p' || doc_id || CASE WHEN starts_with({_DIR}, 'raws/scans') THEN {_pick(PICTURES)} ELSE {_pick(EXTS, '(doc_id // 3)')} END AS path, coalesce(n_chars, 0) AS size, sha256(coalesce(text, '')) AS checksum FROM documents), fl AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM tr)"
_EXT = "lower(regexp_extract({0}, '(?s)[^.].*?(\\.[^.]*)$', 1))"
_TB = f"tb AS (SELECT doc_id AS id, coalesce(text, '') || chr(10) || {_pick(TABLES)} AS text FROM documents), ln AS (SELECT id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) - 1 AS ln FROM tb)"
_CELL = f"len(string_split(regexp_replace(regexp_replace({_tr('line')}, '^\\|', ''), '\\|$', ''), '|'))"
_BK = rf"""{_TB}, rw AS (SELECT id, ln, ln - row_number() OVER (PARTITION BY id ORDER BY ln) AS g, {_CELL} AS cells, regexp_matches(line, '{_SEPSQL}') AS sep FROM ln WHERE regexp_matches(line, '^{_WS}*\|{_NL}*\|{_WS}*$')),
b0 AS (SELECT id, g, min(ln) AS s, max(ln) AS e, arg_min(cells, ln) AS width, min(ln) FILTER (WHERE sep) AS sa FROM rw GROUP BY id, g),
bk AS (SELECT b0.*, rw.cells AS header FROM b0 LEFT JOIN rw ON rw.id = b0.id AND rw.ln = CASE WHEN sa > s THEN sa - 1 ELSE sa END)"""
_ENC = "replace(replace(replace(replace(replace(url_encode({0}), '%21', '!'), '%2A', '*'), '%27', ''''), '%28', '('), '%29', ')')"
_SIZE_TEXT = "CASE " + " ".join(f"WHEN x >= {1024**i} THEN rtrim(rtrim(((x * 100 + {1024**i // 2}) // {1024**i}) // 100 || '.' || lpad((((x * 100 + {1024**i // 2}) // {1024**i}) % 100)::VARCHAR, 2, '0'), '0'), '.') || ' {u}'" for i, u in reversed(list(enumerate(N.UNITS)))) + " ELSE '0 B' END"
_DRIVE = "^(?:/mnt/([A-Za-z]):?|([A-Za-z]):)(/.*)$"
_FWD = "replace(trim(x), '\\', '/')"
_EX = """ex AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE replace(coalesce(text, ''), 'th', 'tH') END AS digital,
CASE doc_id % 5 WHEN 0 THEN 'court' WHEN 1 THEN replace(coalesce(text, ''), 'th', 'tH') WHEN 2 THEN 'a b c d e f g h i j k l' ELSE coalesce(text, '') END AS ocr FROM documents)"""
_GOTRIM = "regexp_replace({0}, '^[\\s\\x0B\\x{{85}}\\x{{A0}}]+|[\\s\\x0B\\x{{85}}\\x{{A0}}]+$', '', 'g')"
_PX = "px AS (SELECT user_id % 5 AS image, least(255, floor(value)::BIGINT + (user_id % 5) * 20)::INT AS grey FROM events)"
_SIM = "CASE WHEN s = t THEN 1.0::DOUBLE ELSE 1 - levenshtein(s, t)::DOUBLE / greatest(length(s), length(t)) END"


def _conflicts(source: str) -> str:
    return f"""{_TAX}, pr AS (SELECT DISTINCT category, {_CMP.format('trim(category)')} AS s FROM {source}), nm AS (SELECT 0 AS rank, min(ord) AS ord, category AS tc, '' AS ts, {_CMP.format('category')} AS t FROM tx WHERE NOT {_forbid('category')} GROUP BY category
UNION ALL SELECT 1, ord, category, subcategory, {_CMP.format('subcategory')} FROM tx WHERE NOT {_forbid('subcategory')}), mt AS (SELECT pr.category, s, rank, ord, tc, ts, t, {_SIM} AS r FROM pr, nm WHERE s <> '' AND t <> ''),
cf AS (SELECT category, arg_min({{'rank': rank, 'tc': tc, 'ts': ts, 'r': r}}, (rank, -r, ord)) AS b FROM mt WHERE r >= 0.82 AND (rank = 1 OR (s <> t AND length(s) >= 4)) GROUP BY category)"""


_LISTED = "CASE " + " ".join(f"WHEN c = {_s(c)}" + "".join(f" OR contains(c, {_s({'Relevé': 'releve'}.get(a, a))})" for a in names) + f" THEN {_s(c)}" for c, names in KNOWN) + " END"

ORACLE_SQL = {
    "file_scan": f"WITH {_TREE} SELECT path, size FROM fl WHERE starts_with(path, 'raws/') AND {_EXT.format('name')} IN ({_s(N.SUPPORTED)[1:-1]}) AND NOT regexp_matches(dir, '/(\\.[^/]*|duplicates_files|duplicates|blocked_files|blocked)(/|$)') AND NOT starts_with(lower(path), 'raws/ignored/')",
    "file_scan_all": f"WITH {_TREE} SELECT path, size FROM fl WHERE {_EXT.format('name')} IN ({_s(N.SUPPORTED)[1:-1]})",
    "directory_stats": f"WITH {_TREE}, k AS (SELECT lower({_kind('path')}) AS format, size FROM fl), g AS (SELECT format, count(*) AS n, sum(size)::BIGINT AS x FROM k GROUP BY ROLLUP (format)) SELECT format, n, x AS bytes, {_SIZE_TEXT} AS human FROM g",
    "image_bundles": f"WITH {_TREE}, c AS (SELECT dir, count(*) AS n FROM fl WHERE starts_with(dir, 'raws/') AND NOT regexp_matches(dir, '/\\.') GROUP BY dir HAVING count(*) >= 2 AND count(*) = count(*) FILTER (WHERE {_kind('name')} = 'IMAGE')) SELECT dir, n FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE starts_with(c.dir, o.dir || '/'))",
    "registry_reconcile": f"WITH {_TREE}, r AS (SELECT checksum, min(id) AS id, arg_min(CASE WHEN id % 3 = 0 THEN path || '.old' ELSE path END, id) AS np FROM tr WHERE id % 4 <> 1 GROUP BY checksum), k AS (SELECT checksum, path FROM tr WHERE id % 5 <> 2) SELECT coalesce(r.checksum, k.checksum) AS checksum, id, path, CASE WHEN path IS NULL THEN 'ghost' WHEN id IS NULL THEN 'unindexed' WHEN np = path THEN 'matched' ELSE 'moved' END AS state FROM r FULL JOIN k USING (checksum)",
    "file_locate": f"""WITH {_TREE}, k AS (SELECT * FROM fl WHERE id % 7 <> 3), d AS (SELECT id, CASE WHEN id % 3 = 0 THEN path ELSE '' END AS np, CASE WHEN id % 4 = 0 THEN path ELSE 'gone/' || name END AS op, CASE WHEN id % 6 = 0 THEN name ELSE upper(name) END AS fn FROM fl)
SELECT id, coalesce((SELECT path FROM k WHERE path = np), (SELECT path FROM k WHERE path = op), (SELECT path FROM k WHERE path = 'raws/a/' || fn), (SELECT min(path) FROM k WHERE lower(name) = lower(fn))) AS found FROM d""",
    "package_ids": f"WITH {_REG}, a AS (SELECT * FROM {_values(list(enumerate(IDS)), 'ord, id')}) SELECT ord, a.id::BIGINT AS id, coalesce(regexp_replace(original_filename, '[^a-zA-Z0-9_.-]', '_', 'g'), '') AS name, r.id IS NULL AS missing FROM a LEFT JOIN r ON r.id = a.id",
    "path_functions": f"""SELECT id, CASE WHEN regexp_matches({_FWD}, '{_DRIVE}') THEN '/mnt/' || lower(regexp_extract({_FWD}, '{_DRIVE}', 1) || regexp_extract({_FWD}, '{_DRIVE}', 2)) || regexp_extract({_FWD}, '{_DRIVE}', 3) ELSE {_FWD} END AS mount,
CASE WHEN regexp_matches(trim(x), '^/mnt/[A-Za-z](/.*)?$') THEN upper(trim(x)[6]) || ':' || replace(CASE WHEN length(trim(x)) = 6 THEN '/' ELSE trim(x)[7:] END, '/', '\\') ELSE trim(x) END AS drive,
array_to_string(list_transform(string_split(x, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title, upper(x[1]) || lower(x[2:]) AS capital, regexp_replace(x, '[/\\\\?%*:|"<>]', '_', 'g') AS safe, regexp_replace(x, '[^a-zA-Z0-9_.-]', '_', 'g') AS entry, {_ENC.format('x')} AS uri,
'attachment; filename="' || regexp_replace(regexp_replace(replace(x, '"', ''''), '[\\x{{10000}}-\\x{{10FFFF}}]', '__', 'g'), '[^ -~]', '_', 'g') || '"; filename*=UTF-8''''' || {_ENC.format('x')} AS header,
{_EXT.format("regexp_extract(x, '([^/\\\\]*)$', 1)")} IN ({_s(N.SUPPORTED)[1:-1]}) AS supported, (lower(replace(x, '\\', '/')) = 'raws/ignored' OR starts_with(lower(replace(x, '\\', '/')), 'raws/ignored/')) AS inside FROM {_num(NAMES, 'x')}""",
    "number_functions": f"SELECT id, try_cast(regexp_extract(trim(x), '^([+-]?[0-9]+)', 1) AS BIGINT) AS whole, CASE WHEN try_cast(x AS DOUBLE) BETWEEN 1 AND 9007199254740991 AND try_cast(x AS DOUBLE) = floor(try_cast(x AS DOUBLE)) THEN try_cast(x AS DOUBLE)::BIGINT END AS row_id FROM {_num(NUMBERS, 'x')}",
    "natural_order": f"""WITH k AS (SELECT id, x, list_transform(regexp_extract_all(x, '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN '0' || lpad(length(regexp_replace(t, '^0+(.)', '\\1'))::VARCHAR, 4, '0') || regexp_replace(t, '^0+(.)', '\\1') ELSE '1' || lower(t) END) AS k FROM {_num(NAMES, 'x')})
SELECT id, x, row_number() OVER (ORDER BY k, id)::INT AS place FROM k""",
    "human_size": f"SELECT id, {_SIZE_TEXT} AS text FROM (SELECT id, x::HUGEINT AS x FROM {_num(SIZES, 'x')})",
    "md_neutralise": f"""WITH {_BK}, w AS (SELECT * FROM bk WHERE header >= 14), o AS (SELECT ln.id, ln.ln, CASE WHEN w.id IS NULL THEN line WHEN ln = s THEN {_s(M.MARKER[0])} || header || {_s(M.MARKER[1])} || chr(10) || '> ' || line ELSE '> ' || line END AS line FROM ln LEFT JOIN w ON w.id = ln.id AND ln.ln BETWEEN s AND e)
SELECT id, md5(string_agg(line, chr(10) ORDER BY ln)) AS md5, (SELECT count(*) FROM w WHERE w.id = o.id) AS blocks FROM o GROUP BY id""",
    "md_merge_blocks": f"""WITH {_BK}, p AS (SELECT *, lag(header) OVER q AS ph, lag(e) OVER q AS pe FROM bk WINDOW q AS (PARTITION BY id ORDER BY s)), c AS (SELECT * FROM p WHERE header IS NULL AND ph = width),
m AS (SELECT c.id, c.pe, c.s FROM c LEFT JOIN ln ON ln.id = c.id AND ln.ln > c.pe AND ln.ln < c.s AND {_tr('line')} <> '' GROUP BY ALL HAVING count(ln.ln) = 0),
n AS (SELECT id, count(*) AS blocks FROM m GROUP BY id), o AS (SELECT id, string_agg(line, chr(10) ORDER BY ln) AS text FROM ln WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = ln.id AND ln.ln > m.pe AND ln.ln < m.s) GROUP BY id)
SELECT tb.id, md5(CASE WHEN n.id IS NULL THEN tb.text ELSE o.text END) AS md5, coalesce(blocks, 0) AS blocks FROM tb LEFT JOIN n USING (id) LEFT JOIN o USING (id)""",
    "chunk_screen": f"""WITH {_TB}, t AS (SELECT id, ln, {_tr('line')} AS line FROM ln), f AS (SELECT *, length(line) - length(replace(line, '|', '')) AS pipes, regexp_matches(line, '^\\|{_NL}*\\|{_WS}*$') AS gfm, coalesce(lead(regexp_matches(line, '{_STRICT}')) OVER (PARTITION BY id ORDER BY ln), false) AS over, regexp_matches(line, '{_STRICT}') AS strict FROM t),
g AS (SELECT id, count(*) FILTER (WHERE NOT gfm AND NOT strict AND pipes >= 2) AS malformed, array_to_string((list(CASE WHEN length(line) > 70 THEN left(line, 70) || '…' ELSE line END ORDER BY ln) FILTER (WHERE NOT gfm AND pipes >= 2))[1:2], '` / `') AS examples, coalesce(max({_CELL}) FILTER (WHERE gfm AND over), 0) AS widest FROM f GROUP BY id)
SELECT id, malformed, coalesce(examples, '') AS examples, widest, malformed > 0 OR widest >= 14 AS repair, concat_ws(' ', CASE WHEN malformed > 0 THEN malformed || ' line(s) carry table cells but are NOT well-formed GFM rows' || CASE WHEN coalesce(examples, '') = '' THEN '' ELSE ', e.g. `' || examples || '`' END || '. Every row of a table must start with `|`, end with `|`, and have EXACTLY as many cells as its header. Do not merge separate columns into one cell and do not leave a column label dangling inside a bold line.' END,
CASE WHEN widest >= 14 THEN 'A table header has ' || widest || ' columns — that is a chart axis or decorative row, not data. Do NOT emit it as a table; keep its labels as plain text lines.' END) AS note FROM g""",
    "noise_removal": f"WITH {_TB} SELECT id, md5({_tr('''regexp_replace(regexp_replace(''' + 'regexp_replace(' * 4 + 'text' + ''.join(f", '(?im){p}', '', 'g')" for p in M.NOISE) + ''', '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')''')}) AS md5 FROM tb",
    "text_refresh": f"WITH {_EX}, t AS (SELECT id, {_tr('ocr')} AS o, digital AS n FROM ex) SELECT id, length(o) < 15 OR contains(o, '[No raw text extracted]') OR (length(n) > 20 AND o <> n) AS refresh FROM t",
    "extraction_choice": f"""WITH {_EX}, tt AS (SELECT id, {_GOTRIM.format('digital')} AS digital, {_GOTRIM.format('ocr')} AS ocr FROM ex), a AS (WITH src AS (SELECT id, digital AS text FROM tt), {_corrupt('src')} SELECT id, b IS NOT NULL AS bad FROM co), z AS (WITH src AS (SELECT id, ocr AS text FROM tt), {_corrupt('src')} SELECT id, b IS NOT NULL AS bad FROM co),
w AS (SELECT id, ocr, regexp_extract_all(ocr, '\\p{{L}}+') AS w FROM tt), q AS (SELECT id, length(ocr) < 10 AS little, len(w) > 0 AND list_sum(list_transform(w, lambda x: length(x))) / len(w) >= 3 AND len(list_filter(w, lambda x: length(x) = 1)) / len(w) <= 0.4 AND len(list_filter(w, lambda x: length(x) <= 2)) / len(w) <= 0.6 AS reads FROM w),
r AS (SELECT q.id, CASE WHEN little THEN 'ocr-unusable' WHEN NOT a.bad THEN 'clean-layer-kept' WHEN z.bad THEN 'ocr-unusable' WHEN NOT reads THEN 'ocr-not-prose' ELSE 'ocr-clean-recovery' END AS reason FROM q JOIN a USING (id) JOIN z USING (id)) SELECT id, CASE WHEN reason = 'ocr-clean-recovery' THEN 'ocr' ELSE 'digital' END AS source, reason FROM r""",
    "refine_classification": f"""WITH v AS (SELECT *, category IN ('personal', 'other') OR subcategory = 'general' OR (category = 'correspondence' AND regexp_matches(fn, '(?i)impot|tax')) AS weak FROM {_num(REFINED, 'category, subcategory, rc, rs, fn')}), a AS (SELECT *, CASE WHEN category IN ('personal', 'other', '') OR (category = 'correspondence' AND rc = 'administrative') THEN rc ELSE category END AS f FROM v)
SELECT id, CASE WHEN NOT weak THEN category WHEN subcategory = 'general' AND rs <> 'general' AND rc <> '' AND f IN ('correspondence', 'other') THEN rc ELSE f END AS category, CASE WHEN NOT weak OR subcategory <> 'general' THEN subcategory WHEN rs <> 'general' THEN rs WHEN f = 'bulletin_salaire' THEN f ELSE subcategory END AS subcategory FROM a""",
    "category_conflict": f"WITH {_conflicts(_num(CATEGORY_NAMES, 'category'))} SELECT category, CASE WHEN b.rank = 0 THEN 'category-near' ELSE 'entity-as-category' END AS kind, b.tc AS to_category, b.ts AS to_subcategory, round(b.r * 100)::BIGINT AS percent FROM cf",
    "resolve_category": f"""WITH i AS (SELECT id, {_slug("CASE WHEN category = '' THEN 'administrative' ELSE category END")} AS c FROM {_num(CATEGORY_NAMES, 'category')}), h AS (SELECT id, c, {_LISTED} AS hit FROM i), src AS (SELECT DISTINCT c AS category FROM h WHERE hit IS NULL), {_conflicts('src')}
SELECT id, coalesce(hit, cf.b.tc, c) AS category, CASE WHEN hit IS NOT NULL THEN 'known' WHEN cf.category IS NOT NULL THEN 'conflict' ELSE 'new' END AS state FROM h LEFT JOIN cf ON cf.category = h.c""",
    "overlay_merge": f"WITH p AS (SELECT * FROM {_values(PUBLIC, 'category, subcategory')}), o AS (SELECT DISTINCT * FROM {_values(PRIVATE, 'category, subcategory')}), u AS (SELECT *, 'public' AS origin FROM p UNION ALL SELECT *, 'private' FROM (SELECT * FROM o EXCEPT SELECT * FROM p)) SELECT * FROM u WHERE NOT {_forbid('subcategory')}",
    "overlay_diff": f"SELECT * FROM (SELECT * FROM {_values(PRIVATE, 'category, subcategory')} EXCEPT SELECT * FROM {_values(PUBLIC, 'category, subcategory')})",
    "ensure_categories": f"WITH {_REG}, {_TAX} SELECT category FROM tx UNION SELECT category FROM r",
    "decision_changes": f"SELECT id FROM {_num(CHANGED, 'a, b, c, d')} WHERE lower(coalesce(a, '')) <> lower(coalesce(c, '')) OR lower(coalesce(b, '')) <> lower(coalesce(d, ''))",
    "subcategory_rename": f"WITH {_REG} SELECT id, category, CASE WHEN lower(category) = 'invoices' AND lower(subcategory) = 'sfr' THEN 'sfr_red' ELSE subcategory END AS subcategory FROM r",
    "duplicate_names": f"WITH {_REG}, n AS (SELECT id, original_filename AS name, row_number() OVER (PARTITION BY original_filename ORDER BY id) - 1 AS i, regexp_extract(regexp_extract(original_filename, '([^/\\\\]*)$', 1), '(?s)[^.].*?(\\.[^.]*)$', 1) AS e FROM r) SELECT id, name, CASE WHEN i = 0 THEN name ELSE left(name, length(name) - length(e)) || '_dup' || i || e END AS unique_name FROM n",
    "task_progress": "WITH u AS (SELECT user_id AS task, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 200 END AS total, floor(value)::BIGINT AS p FROM events), w AS (SELECT task, seq, coalesce(last_value(total IGNORE NULLS) OVER q, 0) AS total, greatest(0, max(p) OVER q) AS processed FROM u WINDOW q AS (PARTITION BY task ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT task, seq, processed, CASE WHEN total > 0 THEN least(100, floor(processed / total * 100 + 0.5)) ELSE 0 END::BIGINT AS percent FROM w",
    "auto_levels": f"""WITH {_PX}, c AS (SELECT image, grey, count(*) AS n FROM px GROUP BY ALL), s AS (SELECT image, grey, sum(n) OVER (PARTITION BY image ORDER BY grey) AS lo, sum(n) OVER (PARTITION BY image ORDER BY grey DESC) AS hi, sum(n) OVER (PARTITION BY image)::DOUBLE * 0.01::DOUBLE AS cut FROM c),
e AS (SELECT image, min(grey) FILTER (WHERE lo > cut) AS b, max(grey) FILTER (WHERE hi > cut) AS w FROM s GROUP BY image), k AS (SELECT *, b / 255 AS l, w / 255 AS h FROM e)
SELECT image, b::BIGINT AS black, w::BIGINT AS white, CASE WHEN h - l < 0.05 OR l + h <= 0.01 THEN 0 ELSE floor(greatest(-50, least(50, (1 / (l + h) - 1) * 100)) + 0.5) END::BIGINT AS brightness, CASE WHEN h - l < 0.05 OR l + h <= 0.01 THEN 0 ELSE floor(greatest(-50, least(50, ((l + h) / (h - l) - 1) * 100)) + 0.5) END::BIGINT AS contrast FROM k""",
    "upper_median": f"WITH {_PX} SELECT image, list_sort(list(grey))[count(*) // 2 + 1] AS median FROM px GROUP BY image",
    "orientation": f"SELECT id::BIGINT AS id, model::BIGINT AS degrees, CASE WHEN model = CASE tag WHEN 1 THEN 0 WHEN 3 THEN 180 WHEN 6 THEN 90 WHEN 8 THEN 270 END THEN 'exif+model-agree' ELSE 'model-only' END AS source FROM {_values(TURNS, 'id, tag, model')}",
    "edit_guards": f"WITH e AS (SELECT id::BIGINT AS id, sub FROM {_values(EDITS, 'id, sub')}) SELECT id, CASE WHEN sub IS NOT NULL AND {_forbid('sub')} THEN 'forbidden' WHEN id NOT IN (SELECT doc_id FROM documents) THEN 'missing' ELSE 'updated' END AS status FROM e",
    "date_reconcile": f"""WITH t AS (SELECT id, date, title, {_tr("coalesce(date, '')")} AS x, try_cast(regexp_extract(coalesce(title, ''), '\\b(20\\d{{2}})\\b', 1) AS INT) AS named FROM {_num(DATED, 'date, title')}),
p AS (SELECT *, CASE WHEN regexp_matches(x, '^\\d{{4}}-\\d\\d-\\d\\d$') THEN x[1:4] || x[6:7] || x[9:10] WHEN regexp_matches(x, '^\\d\\d[/.-]\\d\\d[/.-]\\d{{4}}$') THEN x[7:10] || x[4:5] || x[1:2] WHEN regexp_matches(x, '^\\d\\d[/.-]\\d\\d[/.-]\\d\\d$') THEN '20' || x[7:8] || x[4:5] || x[1:2] END AS k FROM t),
n AS (SELECT *, k[1:4]::INT AS y, k[5:6]::INT AS m, k[7:8]::INT AS d FROM p), c AS (SELECT *, (make_date(y, 1, 1) + to_months(m - 1))::DATE + (d - 1) AS day, (make_date(named, 1, 1) + to_months(m - 1))::DATE + (d - 1) AS fixed FROM n),
z AS (SELECT *, coalesce(day > DATE '{TODAY}' AND named <> y AND fixed <= DATE '{TODAY}', false) AS corrected FROM c) SELECT id, CASE WHEN corrected THEN named || '-' || k[5:6] || '-' || k[7:8] ELSE date END AS date, corrected FROM z""",
    "move_plan": f"""WITH cp AS ({BASE_SQL["canonical_path"]}), {_REG}, n AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'ROOT//invoices/sfr/2024/' || original_filename ELSE '' END AS new_path FROM r)
SELECT id, new_path, path FROM n JOIN cp USING (id) WHERE lower(replace(new_path, '//', '/')) <> lower(path)""",
}
