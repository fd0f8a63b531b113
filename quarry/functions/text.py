"""Column functions for text whose rules differ from Spark's own."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of ECMAScript's trim and \s, as the inside of a character class.
JS_SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Any character but a line end, as ECMAScript reads the dot.
JS_DOT = r"[^\n\r\x{2028}\x{2029}]"


def re2(pattern: str) -> str:
    r"""A pattern whose \b looks at ASCII letters, digits and _ alone, for Java."""
    word = "[0-9A-Za-z_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def once(rows: DataFrame, keep: list[str], name: str, *fields: Column) -> DataFrame:
    """rows with a struct of fields that is worked out once; unlike a projection, a generator isn't merged with what reads it."""
    return rows.select(*keep, F.explode(F.array(F.struct(*fields))).alias(name))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def head_units(c: Column, n: int) -> Column:
    """The first n UTF-16 units of a text; a character of two units that would be cut is left out."""
    head = F.substring(c, 1, n)
    units = F.encode(head, "UTF-16BE")
    half = F.hex(units.substr(2 * n - 1, 1)).between("D8", "DB")
    cut = F.decode(units.substr(F.lit(1), F.when(half, 2 * n - 2).otherwise(2 * n)), "UTF-16BE")
    return F.when(head.rlike(r"[\x{10000}-\x{10FFFF}]"), cut).otherwise(head)


def _folds() -> tuple[str, str]:
    """Letters below U+0250 that decompose to an ASCII letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    kept = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


FROM, TO = _folds()


def fold(c: Column) -> Column:
    """c without accents; letters that do not decompose, such as œ and ß, stay."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(c, FROM, TO), r"[\x{0300}-\x{036F}]", "")).otherwise(c)


def slug(c: Column) -> Column:
    """Folded, trimmed, lower-cased, runs of other characters than a-z 0-9 _ - turned into one _, without _ at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(js_trim(fold(c))), "[^a-z0-9_-]+", "_"), "^_+|_+$", "")


def compare_slug(c: Column) -> Column:
    return F.regexp_replace(fold(F.lower(c)), "[^a-z0-9]", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 0 if one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longest).cast("double")


def extension(c: Column) -> Column:
    """The last dot of a base name and what follows; empty without one or with only a leading one."""
    return F.regexp_extract(F.regexp_extract(c, r"([^/\\]*)$", 1), r"(?s)[^.].*?(\.[^.]*)$", 1)


#: File types by extension; anything else is PDF.
FILE_TYPES = {"IMAGE": [".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff"], "TEXT": [".txt", ".md", ".csv", ".log", ".json"], "WORD": [".docx", ".doc"], "EXCEL": [".xlsx", ".xls"]}


def file_type(c: Column) -> Column:
    ext = F.lower(F.trim(extension(c)))
    out = F.lit("PDF")
    for kind, known in FILE_TYPES.items():
        out = F.when(ext.isin(known), kind).otherwise(out)
    return out


#: Subcategories that say nothing.
FORBIDDEN = ["general", "other", "divers", "unknown", "none", "anyscanner", "camscanner", "geniusscan", "adobescan", "tinyscanner", "simplescan", "docscanner", "jpg", "jpeg", "png", "webp", "bmp", "tiff", "pdf", "txt", "docx", "xlsx"]
_EXT = "(pdf|jpg|jpeg|png|webp|tiff|bmp|txt|docx|xlsx)"
#: Shapes of subcategories that come from file names.
FORBIDDEN_SHAPES = [f"[._-]{_EXT}$", rf"^(\d+|img\d*|scan\d*|photo\d*|doc\d*|file\d*)[_.]?{_EXT}$"]
SCANNERS = "^(anyscanner|camscanner|geniusscan|adobescan|tinyscanner|simplescan|docscanner)"


def forbidden_subcategory(c: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    bare = F.regexp_replace(raw, "[^a-z0-9]+", "")
    shapes = [raw.rlike(p) for p in FORBIDDEN_SHAPES]
    return (bare == "") | raw.isin(FORBIDDEN) | bare.isin(FORBIDDEN) | bare.rlike(r"^\d+$") | shapes[0] | shapes[1] | bare.rlike(SCANNERS)


#: Shapes of the stem of a file name that say nothing of the document.
GENERIC_STEMS = [
    r"^\d+$", r"^[a-f0-9]{16,64}", r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", r"(_blocked\d*|_dup\d*|\(\d+\)|_copy\d*)$",
    r"^(qptmp|scan[-_]?\d*|doc[-_]?\d*|img[-_]?\d*|photo[-_]?\d*|file[-_]?\d*|tmp[-_]?\d*|temp[-_]?\d*|fileopen[-_]?\d*|untitled|non_nomme|recap)",
    r"^(invoice|facture|receipt|download|document|recap)[-_\s\(\d]+$", r"^\d{8,}[-_]",
]


def stem(c: Column) -> Column:
    base = F.regexp_extract(c, r"([^/\\]*)$", 1)
    return F.lower(F.trim(base.substr(F.lit(1), F.length(base) - F.length(extension(c)))))


def generic_filename(c: Column) -> Column:
    s = stem(c)
    out = F.length(s) <= 3
    for p in GENERIC_STEMS:
        out = out | s.rlike(p)
    return out

