"""Column functions for paths, names, sizes and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import JS_SPACE, extension, js_trim

#: The extensions that are read.
SUPPORTED = ".pdf .png .jpg .jpeg .webp .bmp .tiff .txt .md .csv .log .json .docx .xlsx .xls".split()
#: Units of sizes, each 1024 of the one before.
UNITS = ["B", "KB", "MB", "GB", "TB"]
#: Escapes that the URL encoder makes and that stay characters here, and the plus it writes for a space.
PLAIN = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def supported(c: Column) -> Column:
    return F.lower(extension(c)).isin(SUPPORTED)


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, "([^/]*)$", 1)


def folder(c: Column) -> Column:
    return F.regexp_replace(c, "/[^/]*$", "")


def inside(path: Column, directory: str) -> Column:
    """Whether a path is a folder or lies below it; letters of either case are equal and both kinds of slash."""
    p, d = (F.lower(F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), "(?<=.)/+$", "")) for x in (path, F.lit(directory)))
    return (p == d) | p.startswith(F.concat(d, F.lit("/")))


def to_mount(c: Column) -> Column:
    """A drive path, in any of its three spellings, as a path below /mnt."""
    p = F.replace(F.trim(c), F.lit("\\"), F.lit("/"))
    drive = r"(?s)^(?:/mnt/([A-Za-z]):?|([A-Za-z]):)(/[^\n]*)\z"
    letter = F.lower(F.concat(F.regexp_extract(p, drive, 1), F.regexp_extract(p, drive, 2)))
    return F.when(p.rlike(drive), F.concat(F.lit("/mnt/"), letter, F.regexp_extract(p, drive, 3))).otherwise(p)


def to_drive(c: Column) -> Column:
    """A path below /mnt/<letter> as a drive path; others as they are."""
    p = F.trim(c)
    mount = r"^/mnt/([A-Za-z])(/[^\n]*)?\z"
    rest = F.regexp_extract(p, mount, 2)
    tail = F.replace(F.when(rest == "", "/").otherwise(rest), F.lit("/"), F.lit("\\"))
    return F.when(p.rlike(mount), F.concat(F.upper(F.regexp_extract(p, mount, 1)), F.lit(":"), tail)).otherwise(p)


def human_size(c: Column) -> Column:
    """Bytes in the largest unit below them, with at most two decimals, halves up, without zeros at the end."""
    out = F.lit("0 B")
    for i, unit in enumerate(UNITS):
        k = 1024**i
        hundredths = F.expr(f"{k} div 2") + c.cast("decimal(20,0)") * 100
        whole = F.floor(hundredths / F.lit(k)).cast("long")
        text = F.concat(F.floor(whole / 100).cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))
        out = F.when(c >= k, F.concat(F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")), F.lit(f" {unit}"))).otherwise(out)
    return out


def whole_number(c: Column) -> Column:
    """The integer at a text's start, after white space and a sign; null without one or beyond 64 bits."""
    return F.regexp_extract(js_trim(c), r"^([+-]?[0-9]+)", 1).try_cast("long")


def row_id(c: Column) -> Column:
    """A number as an id: whole and from 1 to 2^53 - 1; else null."""
    n = c.try_cast("double")
    return F.when((n >= 1) & (n <= 2**53 - 1) & (n == F.floor(n)), n.cast("long"))


def rounded(c: Column) -> Column:
    """Half-way numbers go up, below zero too."""
    return F.floor(c + 0.5).cast("long")


def _first_upper(rest):
    return lambda w: F.concat(F.upper(F.substring(w, 1, 1)), rest(F.substr(w, F.lit(2))))


def title_of_slug(c: Column) -> Column:
    """Words of a slug with a capital each; what follows it stays as it is."""
    return F.array_join(F.transform(F.split(c, "_"), _first_upper(lambda x: x)), " ")


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def safe_title(c: Column) -> Column:
    return F.regexp_replace(c, r'[/\\?%*:|"<>]', "_")


def safe_entry(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_.-]", "_")


def uri_component(c: Column) -> Column:
    out = F.url_encode(c)
    for found, wanted in PLAIN.items():
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def attachment(c: Column) -> Column:
    """The header that names a download: an ASCII name, and the name in UTF-8."""
    ascii_name = F.replace(c, F.lit('"'), F.lit("'"))
    ascii_name = F.regexp_replace(F.regexp_replace(ascii_name, r"[\x{10000}-\x{10FFFF}]", "__"), r"[^\x20-\x7E]", "_")
    return F.concat(F.lit('attachment; filename="'), ascii_name, F.lit("\"; filename*=UTF-8''"), uri_component(c))


def natural_key(c: Column) -> Column:
    """An array to sort names by: runs of digits by their number and before other text, which is folded to lower case."""
    number = lambda t: F.regexp_replace(t, "^0+(?=.)", "")
    digits = lambda t: F.concat(F.lit("0"), F.lpad(F.length(number(t)).cast("string"), 4, "0"), number(t))
    parts = F.regexp_extract_all(c, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.transform(parts, lambda t: F.when(t.rlike("^[0-9]"), digits(t)).otherwise(F.concat(F.lit("1"), F.lower(t))))


def clipped(c: Column, units: int) -> Column:
    """At most so many UTF-16 units; a character that would be cut in half goes."""
    astral = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"[\x{10000}-\x{10FFFF}]", ""))
    narrow = F.substring(c, 1, units)
    sizes = F.transform(F.split(narrow, ""), lambda x: F.when(x.rlike(r"[\x{10000}-\x{10FFFF}]"), 2).otherwise(1))
    ends = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    kept = F.size(F.filter(ends, lambda e: e <= units))
    return F.when(astral(narrow) == 0, narrow).otherwise(F.substr(narrow, F.lit(1), kept))


def blank(c: Column) -> Column:
    return c.rlike(rf"^[{JS_SPACE}]*\z")
