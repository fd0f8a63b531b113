"""JSON as people and models write it: repaired, read, and lists of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import JS_SPACE, js_trim

#: Marks round code, and commas before a closing bracket.
FENCE = "(?i)```(?:json)?"
LATE_COMMA = rf",[{JS_SPACE}]*([}}\]])"


def closed(c: Column) -> Column:
    """A text whose open string and brackets are closed at its end, in one pass over its characters; brackets in strings don't count."""
    state = F.struct(F.lit(False).alias("text"), F.lit(False).alias("escaped"), F.lit("").alias("open"))

    def step(a: Column, x: Column) -> Column:
        top = F.substring(a["open"], 1, 1)
        rest = F.substr(a["open"], F.lit(2))
        plain = ~a["escaped"] & ~a["text"]
        shut = plain & (((x == "}") & (top == "{")) | ((x == "]") & (top == "[")))
        opened = F.when(plain & x.isin("{", "["), F.concat(x, a["open"])).when(shut, rest).otherwise(a["open"])
        return F.struct(F.when(~a["escaped"] & (x == '"'), ~a["text"]).otherwise(a["text"]).alias("text"), (~a["escaped"] & (x == "\\")).alias("escaped"), opened.alias("open"))

    end = F.aggregate(F.split(c, ""), state, step)
    return F.concat(c, F.when(end["text"], '"').otherwise(""), F.translate(end["open"], "{[", "}]"))


def strict_json(c: Column) -> Column:
    """A text that is one JSON value and nothing else, as a variant; null otherwise. A parser alone would stop after the first value."""
    held = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.when(F.size(F.try_variant_get(held, "$", "array<variant>")) == 1, F.try_variant_get(held, "$[0]", "variant"))


def tolerant_json(c: Column) -> Column:
    """The object in a text as a variant: fences and what stands round it go, as do late commas; where it still can't be read its open ends are closed. Null if there is none."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), FENCE, "")
    text = js_trim(F.when(F.instr(bare, "{") > 0, F.substr(bare, F.instr(bare, "{"))))
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    whole = F.when(F.instr(text, "}") > 0, F.substr(text, F.lit(1), last)).otherwise(text)
    tidy = lambda x: F.regexp_replace(x, LATE_COMMA, "$1")
    return F.coalesce(strict_json(tidy(whole)), strict_json(tidy(closed(text))))


def _listed(c: Column) -> Column:
    return F.transform(F.split(c, ","), lambda x: F.trim(x))


def stored_keywords(c: Column) -> Column:
    """Keywords as they are stored: the texts of a JSON array; other JSON is none; what is no JSON is a list with commas. Null and blank are none."""
    v = strict_json(c)
    none = F.array().cast("array<string>")
    each = F.try_variant_get(v, "$", "array<variant>")
    texts = F.transform(F.filter(each, lambda e: F.schema_of_variant(e) == "STRING"), lambda e: F.try_variant_get(e, "$", "string"))
    plain = F.filter(_listed(c), lambda x: x != "")
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", none).when(v.isNotNull(), F.coalesce(texts, none)).otherwise(plain)


def edited_keywords(c: Column, most: int = 10) -> Column:
    """Keywords as a form sends them, a list with commas: trimmed, none empty, once each, the first ten."""
    return F.slice(F.array_distinct(F.filter(_listed(F.coalesce(c, F.lit(""))), lambda x: x != "")), 1, most)
