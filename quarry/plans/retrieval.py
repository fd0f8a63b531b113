"""Retrieval from a message to the rows of an answer: plan, search down the ladder, fall back on points, render."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.json_text import strict_json
from quarry.functions.text import JS_SPACE, js_trim
from quarry.plans.search import STOPWORDS, Query, _scan, asked_for, document_day, ranked, token_scores
from quarry.sources.registry import or_general, stored_type

#: Rows that are fetched for each one wanted, before pay periods are made one.
HEADROOM = 3
#: The lines that documents are rendered as, and the frame of a prompt.
LINE = '[Doc #%d] Title: "%s" | Format: %s | Category: %s | Date: %s | Amount: %s\nSummary: %s'
PROMPT = ("Documents disponibles dans la base locale (via MCP):\n", "Aucun document spécifique trouvé.", '\n\nDemande de l\'utilisateur: "', '"')


def heuristic(message: str, tags: tuple[str, ...] = ()) -> Query:
    """The plan of a message without a model: its words as entities if they are known tags, else as keywords; the last year bounds the date."""
    words = [t for t in re.split(r"[\s\u00a0,.;:!?/\\'\"()\[\]]+", message.lower()) if t]
    years = [t for t in words if re.fullmatch(r"19[5-9]\d|20\d\d|2100", t)]
    kept = [t for t in words if t not in years and len(t.encode("utf-16-le")) > 4 and t not in STOPWORDS]
    known = {t.lower() for t in tags}
    bounds = {"date_from": f"{years[-1]}-01-01", "date_to": f"{years[-1]}-12-31"} if years else {}
    return Query(entities=tuple(t for t in kept if t in known), keywords=tuple(t for t in kept if t not in known), **bounds)


def one_per_period(rows: DataFrame) -> DataFrame:
    """Ranked rows (with category, date) without payslips of a month that has one with a greater id among them; the order stays."""
    day = document_day(F.col("date"))
    period = F.when(F.lower("category") != "bulletin_salaire", F.concat(F.lit("#"), F.col("id"))).when(day == 0, F.concat(F.lit("?"), F.col("id"))).otherwise(F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM"))
    return rows.withColumn("_last", F.max("id").over(Window.partitionBy(period))).where("id = _last").drop("_last")


def retrieved(docs: DataFrame, message: str, plan: Query | None = None) -> DataFrame:
    """(rank, id) of the rows that answer a message.

    As many as the message asks for, else as the plan says, else 10. The
    first rung of the plan's ladder that finds rows gives them, three times
    as many at first, of which only the newest payslip of a month stays.
    Where no rung finds any, the rows with most points, else the newest, as
    many as were asked for (else 10, and 5), again one payslip a month.
    """
    plan, asked = plan or heuristic(message), asked_for(message)
    most = asked or plan.limit or 10
    of = docs.select("id", "category", "date")
    steps = []
    if plan.ladder():
        rows, totals, phrases = _scan(docs, plan)
        for q in plan.ladder():
            hits = ranked(rows, totals, phrases, q, most * HEADROOM).join(of, "id")
            steps.append(one_per_period(hits).withColumn("place", F.row_number().over(Window.orderBy("rank"))).where(F.col("place") <= most).select("place", "id"))
    points = token_scores(docs, message).join(of, "id")
    best = points.where("score > 0").orderBy(F.desc("score"), F.desc("day"), F.desc("id")).limit(asked or 10)
    newest = points.orderBy(F.desc("day"), F.desc("id")).limit(asked or 5)
    order = Window.orderBy(F.desc("score"), F.desc("day"), F.desc("id"))
    late = Window.orderBy(F.desc("day"), F.desc("id"))
    placed = lambda x, w: one_per_period(x.withColumn("place", F.row_number().over(w))).select("place", "id")
    steps += [placed(best, order), placed(newest, late)]
    every = reduce(DataFrame.unionByName, [x.select(F.lit(i).alias("step"), "place", "id") for i, x in enumerate(steps)])  # a bounded number of rows each
    first = every.withColumn("first", F.min("step").over(Window.partitionBy(F.lit(1)))).where("step = first")
    return first.select(F.row_number().over(Window.orderBy("place")).alias("rank"), "id")


def formatted(docs: DataFrame, with_type: bool = True) -> DataFrame:
    """The fields of rows that an answer shows: subcategory general, the title for a missing file name, the original path for a missing new one, the type by name."""
    name = F.coalesce(F.nullif("original_filename", F.lit("")), "title")
    kind = [stored_type().alias("file_type")] if with_type else []
    rows = docs.withColumn("original_filename", name)
    return rows.select("id", "checksum", "title", "date", "category", or_general("subcategory").alias("subcategory"), "summary", "total_amount", "original_filename", F.coalesce(F.nullif("new_path", F.lit("")), "original_path").alias("new_path"), *kind)


def context_line() -> Column:
    """A row as a line of a prompt."""
    filled = lambda c, empty: F.coalesce(F.nullif(c, F.lit("")), F.lit(empty))
    sub = F.when(F.coalesce("subcategory", F.lit("")) == "", F.col("category")).otherwise(F.concat_ws("/", "category", "subcategory"))
    return F.format_string(LINE, "id", "title", stored_type(), sub, filled("date", "N/A"), filled("total_amount", "N/A"), filled("summary", "No summary"))


def prompt(docs: DataFrame, ranks: DataFrame, message: str) -> DataFrame:
    """(prompt): one row, the documents of ranks (rank, id) in their order, a blank line between them, and the message."""
    lines = docs.join(F.broadcast(ranks), "id").agg(F.sort_array(F.collect_list(F.struct("rank", context_line().alias("line")))).alias("l"))  # as many rows as an answer has
    body = F.when(F.size("l") == 0, PROMPT[1]).otherwise(F.array_join(F.transform("l", lambda x: x["line"]), "\n\n"))
    return lines.select(F.concat(F.lit(PROMPT[0]), body, F.lit(PROMPT[2] + message + PROMPT[3])).alias("prompt"))


#: Kinds of values that a field of a structured query may have.
TERMS, TEXTS = ("docTypes", "entities", "keywords", "notTerms"), ("category", "subcategory", "dateFrom", "dateTo")


def parsed_plan(c: Column) -> Column:
    """A structured query in JSON as a struct; null if it is no object or a field is of a wrong kind.

    Term arrays keep their texts alone; null and missing ones are empty.
    Texts are trimmed, blank ones null. limit is a whole number or a text
    that begins with one, from 1 to 50, else null. A key that stands twice
    makes the whole null.
    """
    v = strict_json(c)
    kind = lambda x: F.schema_of_variant(x)
    at = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    none = lambda x: x.isNull() | F.is_variant_null(x)
    bad, fields = ~kind(v).startswith("OBJECT"), []
    for name in TERMS:
        x = at(name)
        each = F.try_variant_get(v, f"$.{name}", "array<variant>")
        bad = bad | (~none(x) & ~kind(x).startswith("ARRAY"))
        texts = F.transform(F.filter(each, lambda e: kind(e) == "STRING"), lambda e: F.try_variant_get(e, "$", "string"))
        fields.append(F.coalesce(texts, F.array().cast("array<string>")).alias(name))
    for name in TEXTS:
        x = at(name)
        bad = bad | (~none(x) & (kind(x) != "STRING"))
        fields.append(F.nullif(js_trim(F.try_variant_get(v, f"$.{name}", "string")), F.lit("")).alias(name))
    x, text = at("limit"), F.try_variant_get(v, "$.limit", "string")
    number = kind(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)")
    bad = bad | (~none(x) & ~number & (kind(x) != "STRING"))
    whole = F.regexp_extract(text, rf"^[{JS_SPACE}]*([+-]?[0-9]+)", 1).try_cast("int")
    exact = F.try_variant_get(v, "$.limit", "double")
    n = F.when(number & (exact == F.floor(exact)), exact.cast("int")).when(kind(x) == "STRING", whole)
    fields.append(F.when(n.between(1, 50), n).alias("limit"))
    return F.when(~F.coalesce(bad, F.lit(True)), F.struct(*fields))
