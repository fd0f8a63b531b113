"""The document registry: its frame over the supplied tables, listings, statistics and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import ascii_lower, file_type, head_units

#: Values dealt over the documents by their id, so that each rule meets its cases and its near misses.
CATEGORIES = ["invoices", "Invoices", "bank", "health", "bulletin_salaire", "housing", "administrative", "ÉTUDES"]
SUBCATEGORIES = ["sfr", "SFR", "edf", "", "general", "bnp_paribas", "2023", "Santé", "scan_12.pdf"]
TITLES = ["Facture Mai SFR", "Relevé de compte", "Attestation santé", "Bulletin de paie", "", "Quittance de loyer", "Notes \"diverses\""]
FILES = ["img001.jpg", "facture_sfr_2024.pdf", "scan-12.pdf", "NORTHWIND_2024.pdf", "notes.txt", "20240101_x.docx", ".bashrc", "a.b/Avis Impôt.PDF", "archive.tar.gz", "foo."]
DATES = ["2024-05-12", "12/05/2024", "2023-02-30", "", "vers 2022", "2026-01-15", "2024-13-01", "le 31/12/2023 et 2020-01-01"]
PHRASES = [
    "relevé de compte bnp paribas solde créditeur", "avis d'impôt sur le revenu dgfip", "facture n° 12 edf total ttc 20240115 payé", "bulletin de paie net à payer",
    "carte vitale", "contrat de travail cdi", "quittance de loyer", "certificat de scolarité alternance", "arrêt de travail sante", "santé ok", "allianz dépôt de plainte", "lettre de motivation",
    "manuel guide", "rapport synthèse 2024-02-03", "passeport 03/02/2024 à payer", "khAu cAn roAN kWh mAh", "courrier email", "antai amende", "rien de tel", "navigo bus",
]


REFERENCES = ["REF-001", "", "2024/17 b", "sfr-9"]
EXPIRIES = ["", "2027-01-31", "", "2025-12-01", ""]
AMOUNTS = ["12.98", "", "1 204,00"]
VATS = ["2.16", "", "0.00", ""]
SIRENS = ["", "123456789"]
IBANS = ["", "", "FR7630006000011234567890189"]
NAMES = ["", "SFR Client", "Anne \"A\" Noël"]
EMAILS = ["", "aide@sfr.fr", "x@y.org", ""]
PHONES = ["", "01 02 03 04 05"]
ADDRESSES = ["", "1 rue de la Paix\n75002 Paris", "9 quai d'Orsay"]
SITES = ["", "https://sfr.fr", ""]
KINDS = ["", "PDF", "image", "", "Word"]
STATUSES = ["PENDING", "COMPLETED", "ERROR"]
STAMPS = ["2026-01-15T08:00:00.000Z", "2026-02-01T09:30:15.250Z"]
#: The columns of a listing, those searched in a listing and in the export, those of the JSON registry and of a search by tool.
LISTED = "id checksum title registre date category subcategory summary tags raw_text markdown_content total_amount vat_amount siren iban expiry_date contact_name contact_email contact_phone contact_address contact_website original_filename original_path new_path status created_at updated_at".split()
SEARCHED = "original_path new_path title original_filename summary registre subcategory contact_name contact_email tags raw_text".split()
EXPORT_SEARCHED = "title original_filename summary registre subcategory contact_name contact_email tags".split()
JSON_FIELDS = "id checksum title registre date category subcategory summary tags original_filename original_path new_path status created_at updated_at".split()
TOOL_SEARCHED = "title summary registre tags subcategory raw_text".split()
TOOL_FIELDS = "id title registre date category subcategory file_type summary new_path status".split()
#: The header of the export, and its columns.
CSV_HEADER = ["ID", "Checksum", "Title", "Category", "Subcategory", "Date", "Expiry Date", "Total Amount", "VAT Amount", "SIREN", "IBAN", "Contact Name", "Contact Email", "Contact Phone", "Contact Address", "Contact Website", "Reference", "Status", "Summary", "Original Filename", "New Path"]
CSV_FIELDS = "id checksum title category subcategory date expiry_date total_amount vat_amount siren iban contact_name contact_email contact_phone contact_address contact_website registre status summary original_filename new_path".split()


def dealt(values: list, by: Column) -> Column:
    """The value whose place is by modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values)).cast("int") + 1)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the registry: the documents with a phrase added to their text and fields dealt by id. No shuffle; columns that aren't used are not read."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    return d.select(
        i.alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"), dealt(TITLES, i).alias("title"), dealt(CATEGORIES, i).alias("category"), dealt(SUBCATEGORIES, i).alias("subcategory"),
        dealt(DATES, i).alias("date"), dealt(FILES, i).alias("original_filename"), F.concat(F.lit("C:/raws/"), F.col("source"), F.lit("/"), dealt(FILES, i)).alias("original_path"),
        F.concat(F.lit('["'), "lang", F.lit('","'), "source", F.lit('"]')).alias("tags"), F.concat(F.lit("résumé\n"), F.col("lang")).alias("summary"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), dealt(PHRASES, i)).alias("raw_text"),
        dealt(REFERENCES, i).alias("registre"), F.when(i % 3 == 1, "").otherwise(F.concat(F.lit("D:/archive/"), F.col("source"), F.lit("/"), dealt(FILES, i))).alias("new_path"), F.concat(F.lit("# "), dealt(TITLES, i), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("markdown_content"),
        *(dealt(v, i).alias(c) for c, v in {"expiry_date": EXPIRIES, "total_amount": AMOUNTS, "vat_amount": VATS, "siren": SIRENS, "iban": IBANS, "contact_name": NAMES, "contact_email": EMAILS, "contact_phone": PHONES, "contact_address": ADDRESSES, "contact_website": SITES, "file_type": KINDS, "status": STATUSES, "created_at": STAMPS, "updated_at": STAMPS[::-1]}.items()),
        F.lit("").alias("source_image_path"), F.lit("[]").alias("embedding"),
    )


def or_general(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("general"))


def parsed_tags(c: Column) -> Column:
    """A JSON array in text as an array; anything else as an empty one."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def _holds(q: str, fields: list[str]) -> Column:
    """Whether one of the fields holds q, letters of either case; an empty q is held by all."""
    hit = F.lit(not q)
    for f in fields if q else ():
        hit = hit | F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(q.lower()))
    return hit


def filtered(docs: DataFrame, category: str = "", subcategory: str = "", q: str = "", fields: list[str] = SEARCHED) -> DataFrame:
    """Rows as the listing filters them: equal category and subcategory, in letters of either case, and q in one of the fields; an empty subcategory never equals one."""
    out = docs.where(F.lower("category") == category.lower()) if category else docs
    if subcategory:
        out = out.where((F.col("subcategory") != "") & (F.lower("subcategory") == subcategory.lower()))
    return out.where(_holds(q, fields)) if q else out


def listing(docs: DataFrame, category: str = "", subcategory: str = "", q: str = "") -> DataFrame:
    """The LISTED columns of the rows that pass the filters, newest id first: subcategory defaults to general, 800 UTF-16 units of text, tags as an array.

    Null texts read as empty; an empty table gives an empty one; rows of one id are all listed.
    """
    made = {"subcategory": or_general("subcategory"), "raw_text": head_units(F.coalesce("raw_text", F.lit("")), 800), "tags": parsed_tags(F.col("tags"))}
    rows = filtered(docs, category, subcategory, q)
    return rows.select(*(made.get(c, F.col(c) if c == "id" else F.coalesce(c, F.lit(""))).alias(c) for c in LISTED)).orderBy(F.desc("id"))


def stored_type(name: str = "original_filename") -> Column:
    """The file type of a row, else that of its file name."""
    return F.coalesce(F.nullif("file_type", F.lit("")), file_type(F.coalesce(name, F.lit(""))))


def tool_search(docs: DataFrame, q: str = "", category: str = "", subcategory: str = "", kind: str = "", limit: int = 20) -> DataFrame:
    """TOOL_FIELDS and count of at most `limit` rows, newest first, whose searched fields hold q.

    limit 0 means 20, a negative one leaves out as many of the oldest; count,
    in each row, is the number of rows that are returned.
    """
    out = docs.where(F.lower("category") == category.lower()) if category else docs
    out = out.where(F.lower("subcategory") == subcategory.lower()) if subcategory else out
    out = out.where(F.upper(stored_type()) == kind.upper()) if kind else out
    found = out.where(_holds(q, TOOL_SEARCHED)).select(*(stored_type().alias(c) if c == "file_type" else F.col(c) for c in TOOL_FIELDS))
    most = max(0, found.count() + limit) if limit < 0 else limit or 20
    return found.orderBy(F.desc("id")).limit(most).withColumn("count", F.count("*").over(Window.partitionBy()))


def lookup(docs: DataFrame, doc_id: int | None = None, checksum: str | None = None) -> DataFrame:
    """The row of an id or of a checksum, the least id if several have it; none if there is none."""
    rows = docs.where(F.col("id") == doc_id) if doc_id is not None else docs.where(F.col("checksum") == checksum)
    return rows.orderBy("id").limit(1)


def with_defaults(rows: DataFrame) -> DataFrame:
    """Rows as they are inserted: subcategory general, the file type by name, status PENDING, no tags and no embedding where a row says nothing; null texts empty."""
    made = {"subcategory": or_general("subcategory"), "file_type": stored_type(), "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("PENDING"))}
    made |= {c: F.coalesce(F.nullif(c, F.lit("")), F.lit("[]")) for c in ("tags", "embedding")}
    kinds = dict(rows.dtypes)
    return rows.select(*(made[c].alias(c) if c in made else F.coalesce(c, F.lit("")).alias(c) if kinds[c] == "string" else F.col(c) for c in rows.columns))


def _csv_line(cells: list[Column]) -> Column:
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *map(cell, cells))


def csv_lines(docs: DataFrame, category: str = "", subcategory: str = "", q: str = "") -> DataFrame:
    """(id, line): each row that passes the filters as a line of the export; all cells quoted, quotes doubled, line ends of the summary as spaces, the original path where there is no new one."""
    made = {"summary": F.regexp_replace("summary", r"\r?\n", " "), "new_path": F.coalesce(F.nullif("new_path", F.lit("")), "original_path")}
    rows = filtered(docs, category, subcategory, q, EXPORT_SEARCHED)
    return rows.select("id", _csv_line([made.get(c, F.col(c)) for c in CSV_FIELDS]).alias("line"))


def export_csv(docs: DataFrame, path: str, **filters: str) -> None:
    """Writes the export to a folder whose part files, in the order of their names, are it: a byte order mark, the header, and the rows, newest first, lines ended by CRLF.

    The rows are sorted by range of id, so each task writes its share; the last line is ended too.
    """
    head = docs.sparkSession.range(1).select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("\ufeff"), _csv_line([F.lit(c) for c in CSV_HEADER])).alias("line"))
    csv_lines(docs, **filters).unionByName(head).orderBy(F.desc_nulls_first("id")).select("line").write.option("lineSep", "\r\n").mode("overwrite").text(path)


def json_lines(docs: DataFrame) -> DataFrame:
    """(id, line): each row as an object of the JSON registry, tags as an array, nothing in the subcategory as general."""
    made = {"id": F.col("id"), "subcategory": or_general("subcategory"), "tags": parsed_tags(F.col("tags"))}
    return docs.select("id", F.to_json(F.struct(*(made.get(c, F.coalesce(c, F.lit(""))).alias(c) for c in JSON_FIELDS))).alias("line"))


def category_stats(docs: DataFrame) -> DataFrame:
    """Counts by category and subcategory, by category, and in all (nulls stand for all), ASCII letters folded."""
    keyed = docs.select(ascii_lower(F.col("category")).alias("category"), ascii_lower(or_general("subcategory")).alias("subcategory"))
    return keyed.rollup("category", "subcategory").agg(F.count("*").alias("n"))


def category_tree(docs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Configured subcategories with their counts, 0 by default, and those only the registry has, but for general and years."""
    counts = category_stats(docs).where("category IS NOT NULL AND subcategory IS NOT NULL")
    known = taxonomy.join(counts, ["category", "subcategory"], "left").select("category", "subcategory", F.coalesce("n", F.lit(0)).alias("n"), F.lit(True).alias("configured"))
    only = counts.join(taxonomy, ["category", "subcategory"], "left_anti").where((F.col("subcategory") != "general") & ~F.col("subcategory").rlike(r"^\d{4}$")).select("category", "subcategory", "n", F.lit(False).alias("configured"))
    return known.unionByName(only)


def first_by_checksum(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Rows to insert: of each checksum that isn't known the least id, with how many copies the batch held."""
    new = incoming.join(known.select("checksum"), "checksum", "left_anti")
    return new.groupBy("checksum").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def unblocked(files: DataFrame, blocked: DataFrame) -> DataFrame:
    """Files to process: all but those whose path, time and size are remembered as blocked."""
    return files.join(blocked, ["original_path", "mtime_ms", "size"], "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def prune(table: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return table.join(present.select(key).distinct(), key, "left_semi")


def partial_update(docs: DataFrame, changes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """docs with the fields of changes (by id): null keeps, empty replaces, the English name goes before its alias <field>_fr."""
    new = changes.select(F.col("id"), *(F.coalesce(f, f"{f}_fr").alias(f"_{f}") for f in fields))
    return docs.join(new, "id", "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in docs.columns))


def collision_names(files: DataFrame) -> DataFrame:
    """(id, name, unique_name): the newest keeps the name, the others get their id before the extension."""
    w = Window.partitionBy("name").orderBy(F.desc("id"))
    return files.withColumn("r", F.row_number().over(w)).select("id", "name", F.when(F.col("r") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("id").cast("string"))).alias("unique_name"))
