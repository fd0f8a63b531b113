"""Full-text search and query planning."""

from __future__ import annotations

import re
import unicodedata
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.cuts import cut, shared_folder
from quarry.functions.text import JS_SPACE, fold, once, re2

#: Weights of the indexed columns, k1 and b of BM25, the least idf.
WEIGHTS = {"title": 10.0, "original_filename": 1.0, "original_path": 1.0, "new_path": 1.0, "registre": 1.0, "summary": 3.0, "category": 2.0, "subcategory": 2.0, "tags": 6.0, "raw_text": 0.5}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6

#: Words of a question that aren't searched for.
STOPWORDS = (
    "ai aux avec avoir besoin cette ces dans des donne donner elle est et eux faire fait iel ils les leur mais merci mes moi mon nos notre nous ont ou par pas peux peut plus pour pouvez quel quelle "
    "quels quelles que qui sur ses son sont tous tout toute toutes trouve trouver une veux voir vos votre vous "
    "a about all and any are can find for from get give have i is me my need of please show some the to want with you your"
).split()


_SPACES = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", JS_SPACE)


def normalised(terms: tuple[str, ...]) -> tuple[str, ...]:
    """Terms without white space at the ends, those with a letter or a digit, once each in letters of either case."""
    trimmed = [re.sub(f"^[{_SPACES}]+|[{_SPACES}]+$", "", t) for t in terms]
    return tuple({t.lower(): t for t in reversed(trimmed) if any(c.isalnum() for c in t)}[k] for k in dict.fromkeys(t.lower() for t in trimmed if any(c.isalnum() for c in t)))


@dataclass(frozen=True)
class Query:
    """Facets of a search: all facets must match, each by any of its phrases; no row may hold a phrase of not_terms."""

    doc_types: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    not_terms: tuple[str, ...] = ()
    category: str | None = None
    subcategory: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    limit: int | None = None

    def facets(self) -> list[tuple[str, ...]]:
        return [f for f in map(normalised, (self.doc_types, self.entities, self.keywords)) if f]

    def phrases(self) -> list[str]:
        """Every phrase that is counted, once."""
        found = dict.fromkeys(p for f in [*self.facets(), normalised(self.not_terms)] for p in f)
        return [p for p in found if _plain(p)]

    def ladder(self) -> list[Query]:
        """This query, then without keywords, without not_terms, without entities; rungs that ask for nothing end it."""
        rungs = [self]
        for name in ("keywords", "not_terms", "entities"):
            if getattr(rungs[-1], name):
                rungs.append(replace(rungs[-1], **{name: ()}))
        return [q for q in rungs if q.facets()]


def _plain(phrase: str) -> tuple[str, ...]:
    folded = "".join(c for c in unicodedata.normalize("NFD", phrase.lower()) if not unicodedata.combining(c))
    return tuple(re.findall(r"[^\W_]+", folded))


def _spaced(c: Column) -> Column:
    """The terms of a text, each with a space on either side."""
    terms = F.trim(F.regexp_replace(fold(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", "  "))
    return F.when(terms == "", "").otherwise(F.concat(F.lit(" "), terms, F.lit(" ")))


def _hits(spaced: Column, needle: str) -> Column:
    """How often the needle stands in a text, without overlaps."""
    return F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(needle), F.lit("")))) / len(needle))


def _count(spaced: Column, phrase: tuple[str, ...]) -> Column:
    """How often the phrase stands in a text of spaced terms."""
    if len(set(phrase)) < len(phrase):  # it may overlap itself
        terms = F.split(F.trim(spaced), "  ")
        same = lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(terms, i + j) == p, F.lit(False)) for j, p in enumerate(phrase)])
        return F.size(F.filter(F.sequence(F.lit(0), F.size(terms) - 1), same)).cast("long")
    return _hits(spaced, " " + "  ".join(phrase) + " ").cast("long")


#: Shares of the ids in which a bucket of terms is written.
SHARES = 8
#: Columns of the registry that filters read.
FILTERED = ["category", "subcategory", "date"]


def _indexed(c: str) -> Column:
    """A column as it is indexed: nothing in the subcategory as general, no tags as an empty array."""
    return F.coalesce(c, F.lit({"subcategory": "general", "tags": "[]"}.get(c, "")))


def counted(docs: DataFrame, phrases: list[str]) -> DataFrame:
    """One narrow row for each row of docs: id, the filtered columns, its length d in terms and, for each phrase, its weighted count f0, f1, ...

    The only pass that reads texts; its result is kept, as the frequencies
    and the scores both need it.
    """
    spaced = once(docs, ["id", *FILTERED], "t", *(_spaced(_indexed(c)).alias(c) for c in WEIGHTS))
    length = reduce(lambda a, b: a + b, [F.when(F.col(f"t.{c}") == "", 0).otherwise(_hits(F.col(f"t.{c}"), "  ") + 1) for c in WEIGHTS]).cast("long")
    weighed = [reduce(lambda a, b: a + b, [F.lit(w) * _count(F.col(f"t.{c}"), _plain(p)) for c, w in WEIGHTS.items()]).alias(f"f{i}") for i, p in enumerate(phrases)]
    return cut(once(spaced, ["id", *FILTERED], "x", length.alias("d"), *weighed).select("id", *FILTERED, "x.*"))


def _totals(rows: DataFrame, phrases: list[str]) -> list[Column]:
    return [F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(phrases))]


def ranked(rows: DataFrame, totals: DataFrame, phrases: list[str], query: Query, limit: int = 10) -> DataFrame:
    """(rank, id, score) of the best of counted rows by weighted BM25, the lowest score first, ties by id.

    totals is one row: n_rows and avg_d of the whole table, n0, n1, ... rows
    that hold each phrase. Filters come before the limit; categories compare by case.
    """
    f = {p: F.col(f"f{i}") for i, p in enumerate(phrases)}
    match = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [f[p] > 0 for p in facet if p in f], F.lit(False)) for facet in query.facets()], F.lit(bool(query.facets())))
    for p in normalised(query.not_terms):
        match = match & ~(f[p] > 0) if p in f else match
    for c, v in (("category", query.category), ("subcategory", query.subcategory)):
        match = match & (F.col(c) == v) if v else match
    match = match & (F.col("date") != "") & (F.col("date") >= query.date_from) if query.date_from else match
    match = match & (F.col("date") != "") & (F.col("date") <= query.date_to) if query.date_to else match
    score = F.lit(0.0)
    for i, p in enumerate(phrases):
        if any(p in facet for facet in query.facets()):
            idf = F.log((F.col("n_rows") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
            idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
            score = score - idf * f[p] * (K1 + 1) / (f[p] + K1 * (1 - B + B * F.col("d") / F.col("avg_d")))
    found = rows.where(match).join(F.broadcast(totals), how="cross").select("id", F.round(score, 9).alias("score")).orderBy("score", "id").limit(limit)
    return found.select(F.row_number().over(Window.orderBy("score", "id")).alias("rank"), "id", "score")


def _scan(docs: DataFrame, query: Query) -> tuple[DataFrame, DataFrame, list[str]]:
    phrases = query.phrases()
    rows = counted(docs, phrases)
    return rows, rows.agg(F.count("*").alias("n_rows"), F.avg("d").alias("avg_d"), *_totals(rows, phrases)), phrases


def search(docs: DataFrame, query: Query, limit: int = 10) -> DataFrame:
    """(rank, id, score) of the best rows of docs, by one pass over their texts; see ranked().

    Null columns read as empty (no subcategory as general); rows of one id are
    ranked each; an empty table, or a query without a phrase, gives none.
    """
    rows, totals, phrases = _scan(docs, query)
    return ranked(rows, totals, phrases, query, limit)


def relaxed(docs: DataFrame, query: Query, limit: int = 10) -> DataFrame:
    """(rung, rank, id, score) of the first rung of the ladder that finds anything; all rungs read the same counts."""
    rows, totals, phrases = _scan(docs, query)
    rungs = [ranked(rows, totals, phrases, q, limit).select(F.lit(i).alias("rung"), "*") for i, q in enumerate(query.ladder())]
    if not rungs:
        return docs.sparkSession.createDataFrame([], "rung int, rank int, id long, score double")
    out = reduce(DataFrame.unionByName, rungs)
    return out.withColumn("_first", F.min("rung").over(Window.partitionBy(F.lit(1)))).where("rung = _first").drop("_first")


@dataclass(frozen=True)
class Index:
    """postings (bucket, term, col, id, pos) and documents (id, the filtered columns, d), as write_index() left them."""

    postings: DataFrame
    documents: DataFrame
    buckets: int


def write_index(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes the postings of the indexed columns, by buckets of terms, and the lengths of the rows.

    One shuffle, by bucket and share of the ids, so that a common term is
    spread over as many tasks; files are sorted by term, and a search reads
    the row groups of its terms alone.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    terms = F.array(*(F.struct(F.lit(i).alias("col"), F.split(F.trim(_spaced(_indexed(c))), "  ").alias("terms")) for i, c in enumerate(WEIGHTS)))
    rows = docs.select("id", *FILTERED, F.filter(terms, lambda x: F.get(x["terms"], F.lit(0)) != "").alias("t"))
    each = rows.select("id", F.explode("t").alias("t")).select("id", "t.col", F.posexplode("t.terms").alias("pos", "term"))
    each.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SHARES))).sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    length = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.size(x["terms"]))
    rows.select("id", *FILTERED, length.alias("d")).write.mode("overwrite").parquet(f"{path}/documents")
    docs.sparkSession.createDataFrame([(list(WEIGHTS), buckets)], "columns array<string>, buckets int").write.mode("overwrite").parquet(f"{path}/layout")


def open_index(docs: DataFrame, path: str, buckets: int = 64) -> Index:
    """The index at path; it is written anew if it isn't there, if it is of other columns, or if it is empty and docs isn't."""
    spark = docs.sparkSession
    try:
        layout = spark.read.parquet(f"{path}/layout").first()
        held = spark.read.parquet(f"{path}/documents")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        layout = held = None
    if layout is None or layout["columns"] != list(WEIGHTS) or (held.isEmpty() and not docs.isEmpty()):
        write_index(docs, path, buckets)
        layout = spark.read.parquet(f"{path}/layout").first()
    schema = "term string, col int, id long, pos int, bucket int"
    return Index(spark.read.schema(schema).parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents"), layout["buckets"])


def search_index(index: Index, query: Query, limit: int = 10) -> DataFrame:
    """(rank, id, score) as search() gives them, from the postings of the query's terms alone."""
    phrases = query.phrases()
    terms = sorted({t for p in phrases for t in _plain(p)})
    wanted = index.postings.where(F.col("bucket").isin([r[0] for r in index.postings.sparkSession.range(1).select(F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(index.buckets)).cast("int") for t in terms)))).collect()] if terms else [])).where(F.col("term").isin(terms))
    held = wanted.groupBy("id", "col").agg(*(F.collect_list(F.when(F.col("term") == t, F.col("pos"))).alias(f"t{i}") for i, t in enumerate(terms)))
    place = {t: F.col(f"t{i}") for i, t in enumerate(terms)}

    def starts(plain: tuple[str, ...]) -> Column:
        follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(place[t], p + j) for j, t in enumerate(plain)])
        return F.size(F.filter(place[plain[0]], follows))

    weight = F.element_at(F.array(*map(F.lit, WEIGHTS.values())), F.col("col") + 1)
    rows = held.groupBy("id").agg(F.count("*").alias("cols"), *(F.sum(weight * starts(_plain(p))).alias(f"f{i}") for i, p in enumerate(phrases)))
    rows = index.documents.join(rows, "id")
    whole = index.documents.agg(F.count("*").alias("n_rows"), F.avg("d").alias("avg_d"))
    totals = whole.join(F.broadcast(rows.agg(F.count("*").alias("found"), *(F.coalesce(t, F.lit(0)).alias(f"n{i}") for i, t in enumerate(_totals(rows, phrases))))), how="cross")
    return ranked(rows, totals, phrases, query, limit)


def searched_by_index(docs: DataFrame, query: Query, limit: int = 10) -> DataFrame:
    """search_index() over an index that is written to the shared folder for this one call and removed after it."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    out = cut(search_index(open_index(docs, path), query, limit))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return out


def plan(messages: DataFrame) -> DataFrame:
    """(id, keywords, date_from, date_to) from (id, message): words that aren't short, stopwords or years; the last year rules."""
    words = F.filter(F.split(F.lower("message"), r"[\s\x{00A0},.;:!?/\\'\"()\[\]]+"), lambda t: t != "")
    is_year = lambda t: t.rlike(r"^(19[5-9]\d|20\d\d|2100)$")
    kept = F.filter("words", lambda t: ~is_year(t) & (F.length(t) > 2) & ~t.isin(STOPWORDS))
    year = F.element_at(F.filter("words", is_year), -1)
    return messages.select("id", words.alias("words")).select("id", F.array_join(kept, " ").alias("keywords"), F.size(kept).cast("long").alias("n_keywords"), F.when(F.exists("words", is_year), year).alias("year")).select("id", "keywords", "n_keywords", F.concat("year", F.lit("-01-01")).alias("date_from"), F.concat("year", F.lit("-12-31")).alias("date_to"))


#: How a message asks for a number of documents.
COUNT_NOUN = r"\b(\d+)\s*(derniers?|dernieres?|fiches?|bulletins?|factures?|pay|slips?|statements?|relevés?|docs?|documents?)\b"
COUNT_LAST = r"\b(derniers?|dernieres?|last)\s*(\d+)\b"
COUNT_WORDS = [(3, r"\b(trois|three)\b"), (2, r"\b(deux|two)\b"), (1, r"\b(single|last|dernier|dernière)\b")]


def requested_count(message: Column) -> Column:
    """The number of documents a message asks for, 1 to 20, or null; "last 2" asks for one, as the pattern takes the word."""
    low = F.lower(message)
    named = F.regexp_extract(low, re2(COUNT_NOUN), 1).try_cast("int")
    out = F.lit(None).cast("int")
    for n, p in reversed(COUNT_WORDS):
        out = F.when(low.rlike(re2(p)), n).otherwise(out)
    return F.when((named >= 1) & (named <= 20), named).otherwise(out)


def document_day(date: Column) -> Column:
    """Days since 1970 of a date in text: the ISO form, else day/month/year, else a year alone; 0 if none or not a date.

    A day past the month's end runs on into the next month.
    """
    iso, fr, year = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{2})/(\d{2})/(\d{4})", re2(r"\b(20\d{2})\b")
    part = lambda p, i: F.regexp_extract(date, p, i).try_cast("int")

    def day(y: Column, m: Column, d: Column) -> Column:
        ok = m.between(1, 12) & d.between(1, 31)
        return F.when(ok, F.unix_date(F.make_date(y, F.when(ok, m).otherwise(1), F.lit(1))) + d - 1).otherwise(0)

    none = F.lit(0)
    return F.when(date.rlike(iso), day(part(iso, 1), part(iso, 2), part(iso, 3))).when(date.rlike(fr), day(part(fr, 3), part(fr, 2), part(fr, 1))).when(date.rlike(year), day(part(year, 1), F.lit(1), F.lit(1))).otherwise(none).cast("long")


def token_scores(docs: DataFrame, message: str) -> DataFrame:
    """(id, score, day) of every row for a message: points for its category, subcategory and each of its tokens by field."""
    low = message.lower().strip()
    words = [t for t in re.split(r"[\s,.;:!?/\\_-]+", low) if len(t) > 2]
    f = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "original_filename", "subcategory", "category", "summary")}
    score = F.when(F.contains(F.lit(low), f["category"]) & (F.length(f["category"]) > 2), 10).otherwise(0) + F.when(F.contains(F.lit(low), f["subcategory"]) & (F.length(f["subcategory"]) > 2), 15).otherwise(0)
    for w in words:
        for c, points in (("title", 6), ("original_filename", 5), ("subcategory", 4), ("category", 3), ("summary", 2)):
            score = score + F.when(F.contains(f[c], F.lit(w)), points).otherwise(0)
    return docs.select("id", score.cast("long").alias("score"), document_day(F.col("date")).alias("day"))


def asked_for(message: str) -> int | None:
    """The number of documents that a message asks for, 1 to 20, or None; see requested_count()."""
    low = message.lower()
    named = re.search(COUNT_NOUN, low, re.ASCII)
    if named and 1 <= int(named[1]) <= 20:
        return int(named[1])
    return next((n for n, p in COUNT_WORDS if re.search(p, low, re.ASCII)), None)


def scored(docs: DataFrame, message: str) -> DataFrame:
    """(rank, id, score, day): the best rows, as many as the message asks for, else 10; without any point the newest, as many or 5."""
    rows, asked = token_scores(docs, message), asked_for(message)
    limit, fallback = asked or 10, asked or 5
    best = rows.where("score > 0").orderBy(F.desc("score"), F.desc("day"), F.desc("id")).limit(limit)
    newest = rows.orderBy(F.desc("day"), F.desc("id")).limit(fallback).withColumn("_any", F.lit(1))
    some = best.agg(F.count("*").alias("found"))  # one row
    chosen = best.unionByName(newest.join(F.broadcast(some), how="cross").where("found = 0").select("id", "score", "day"))
    w = Window.orderBy(F.desc("score"), F.desc("day"), F.desc("id"))
    return chosen.select(F.row_number().over(w).alias("rank"), "id", "score", "day")


def one_per_month(docs: DataFrame) -> DataFrame:
    """Rows (id, category, date) without payslips of a month that has one with a greater id; undated ones stay."""
    day = document_day(F.col("date"))
    key = F.when(F.lower("category") != "bulletin_salaire", F.concat(F.lit("#"), F.col("id"))).when(day == 0, F.concat(F.lit("?"), F.col("id"))).otherwise(F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM"))
    return docs.withColumn("_key", key).withColumn("_last", F.max("id").over(Window.partitionBy("_key"))).where("id = _last").select("id", "category", "date")


def cited(answers: DataFrame) -> DataFrame:
    """(id, doc_id) of the retrieved documents that an answer keeps, from (id, answer, doc_ids, asked).

    Those it cites, if they are as many as were asked for or as there are, or
    half or more where no number was asked for (null); else all.
    """
    ids = F.transform(F.regexp_extract_all("answer", F.lit(r"(?i)\[doc #(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    kept = F.array_intersect("doc_ids", ids)
    least = F.when(F.col("asked").isNotNull(), F.least("asked", F.size("doc_ids"))).otherwise(F.ceil(F.size("doc_ids") / 2))
    return answers.select("id", F.explode(F.when((F.size(ids) > 0) & (F.size(kept) >= least), kept).otherwise(F.col("doc_ids"))).alias("doc_id"))
