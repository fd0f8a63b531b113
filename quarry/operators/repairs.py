"""Repairs of Markdown tables and of extracted text. Each works within one row's array of lines, so nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import blank, clipped
from quarry.functions.text import JS_DOT, JS_SPACE, js_trim
from quarry.operators.quality import ROW, SEPARATOR, STRICT_SEPARATOR, cells, corrupted, edge_pipes, lines, malformed_lines

_PY_SPACE = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", JS_SPACE)

#: The number of cells from which a header is a chart's axis, and the marker put before such a block.
CHART_CELLS = 14
MARKER = ("> ⚠️ [Wide non-tabular region (", " columns) — kept verbatim as text, not a data table]")
#: Lines of no meaning that extraction leaves behind.
NOISE = [r"^\[Propriétés Document:[^\]]+\]", r"^\[OCR Extracted Text\]", r"^QPtmp[0-9]+", r"chrome-extension___[a-z0-9_]+"]
#: Bounds of what recognised text must look like to be taken.
PROSE_LENGTH, PROSE_SINGLE, PROSE_SHORT = 3.0, 0.4, 0.6


def _blocks(docs: DataFrame) -> DataFrame:
    """docs with `lines` and `blocks`, an array of (start, end, width, header, sep, data) for each run of table rows.

    start and end are line numbers, width the cells of the first row, header
    the cells of the row before the first separator, or of the separator where
    it comes first; sep is the separator's line, data the lines of the other
    rows. header, sep and data are null without a separator.
    """
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("ln"), x.alias("line")))
    rows = docs.withColumn("lines", lines("text")).withColumn("rows", F.filter(numbered, lambda s: s["line"].rlike(ROW)))
    line_at = lambda i: F.get("rows", i)["ln"]
    places = F.when(F.size("rows") > 0, F.sequence(F.lit(0), F.size("rows") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("firsts", F.filter(places, lambda i: (i == 0) | (line_at(i) - line_at(i - 1) > 1)))
    rows = rows.withColumn("cuts", F.transform("firsts", lambda i, k: F.struct(i.alias("at"), F.coalesce(F.get("firsts", k + 1), F.size("rows")).alias("to"))))

    def block(c: Column) -> Column:
        start = line_at(c["at"])
        sep = F.get(F.filter(F.slice("rows", c["at"] + 1, c["to"] - c["at"]), lambda r: r["line"].rlike(SEPARATOR)), F.lit(0))["ln"]
        head = F.get("lines", F.when(sep > start, sep - 1).otherwise(sep))
        data = F.filter(F.slice("rows", c["at"] + 1, c["to"] - c["at"]), lambda r: (r["ln"] != sep) & (r["ln"] != sep - 1))
        return F.struct(start.alias("start"), line_at(c["to"] - 1).alias("end"), cells(F.get("lines", start)).alias("width"), F.when(sep.isNotNull(), cells(head)).alias("header"), sep.alias("sep"), F.when(sep.isNotNull(), F.transform(data, lambda r: r["line"])).alias("data"))

    return rows.withColumn("blocks", F.transform("cuts", block)).drop("rows", "firsts", "cuts")


def neutralised(docs: DataFrame) -> DataFrame:
    """(id, text, blocks): blocks with a header of 14 cells or more become quoted text below a marker."""
    rows = _blocks(docs.select("id", "text")).withColumn("wide", F.filter("blocks", lambda b: b["header"] >= CHART_CELLS))

    def written(x: Column, i: Column) -> Column:
        here = F.get(F.filter("wide", lambda b: (b["start"] <= i) & (i <= b["end"])), F.lit(0))
        quoted = F.concat(F.lit("> "), x)
        marker = F.concat(F.lit(MARKER[0]), here["header"].cast("string"), F.lit(MARKER[1] + "\n"))
        return F.when(here.isNull(), x).when(here["start"] == i, F.concat(marker, quoted)).otherwise(quoted)

    text = F.when(F.size("wide") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.transform("lines", written), "\n"))
    return rows.select("id", text.alias("text"), F.size("wide").cast("long").alias("blocks"))


def merged(docs: DataFrame) -> DataFrame:
    """(id, text, blocks): a block without header joins the block before it.

    That block must have a header of as many cells as the first row of the
    other, with blank lines alone between them, which go. Without a merge the
    text stays as it is.
    """
    rows = _blocks(docs.select("id", "text"))

    def gap(b: Column, k: Column) -> Column:
        before = F.get("blocks", k - 1)
        between = F.slice("lines", before["end"] + 2, b["start"] - before["end"] - 1)
        joins = (k > 0) & b["header"].isNull() & (before["header"] == b["width"]) & F.forall(between, blank)
        return F.when(joins, F.struct(before["end"].alias("after"), b["start"].alias("before")))

    rows = rows.withColumn("gaps", F.filter(F.transform("blocks", gap), lambda g: g.isNotNull()))
    kept = F.filter("lines", lambda _, i: ~F.exists("gaps", lambda g: (g["after"] < i) & (i < g["before"])))
    text = F.when(F.size("gaps") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.select("id", text.alias("text"), F.size("gaps").cast("long").alias("blocks"))


#: Headings, cells that hold a value, and lines of text that may lie between a table and a row split from it.
HEADING = rf"^#{{1,6}}[{JS_SPACE}]+[^{JS_SPACE}]"
VALUE = rf"^[-–—−]?[{JS_SPACE}]*\(?\d[\d{JS_SPACE}.,€%]*(?:\)[{JS_SPACE}]*)?$"
GAP = 8


def _cells_of(row: Column) -> Column:
    """The trimmed cells of a row, without the pipes at its ends."""
    bare = F.regexp_replace(F.regexp_replace(js_trim(row), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(bare, r"\|", -1), js_trim)


def reattached(docs: DataFrame) -> DataFrame:
    """(id, text, rows): rows whose description became a heading go back to their table.

    Such a heading is followed by a single row of values alone; the nearest
    table with a header above must be one cell wider (its rows, if they are
    all equally wide and wider than the header), end at most GAP lines of text
    above, and the description mustn't end with a colon. Without such a row
    the text stays as it is. rows: how many were moved.
    """
    rows = _blocks(docs.select("id", "text")).withColumn("trimmed", F.transform("lines", js_trim))
    rows = rows.withColumn("full", F.filter(F.transform("trimmed", lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull()))
    at = lambda i: F.get("trimmed", i)
    is_row = lambda x: F.coalesce(x.rlike(ROW), F.lit(False))

    def fold(i: Column, k: Column) -> Column:
        r, after = F.get("full", k + 1), F.get("full", k + 2)
        own = _cells_of(at(r))
        parent = F.try_element_at(F.filter("blocks", lambda b: (b["end"] < i) & b["header"].isNotNull()), F.lit(-1))
        widths = F.array_distinct(F.transform(parent["data"], cells))
        wide = F.when((F.size(widths) == 1) & (F.get(widths, F.lit(0)) > parent["header"]), F.get(widths, F.lit(0))).otherwise(parent["header"])
        gap = F.size(F.filter("full", lambda x: (x > parent["end"]) & (x < i)))
        said = F.regexp_replace(js_trim(F.regexp_replace(at(i), rf"^#{{1,6}}[{JS_SPACE}]+", "")), f"[{JS_SPACE}]+", " ")
        alone = is_row(at(r)) & ~at(r).rlike(SEPARATOR) & ~is_row(at(after)) & (F.size(own) >= 2) & F.forall(own, lambda c: c.rlike(VALUE))
        fits = at(i).rlike(HEADING) & alone & parent.isNotNull() & (F.size(own) + 1 == wide) & (gap <= GAP) & (said != "") & ~said.endswith(":")
        return F.when(fits, F.struct(i.alias("heading"), r.alias("row"), parent["end"].alias("below"), F.concat(F.lit("| "), said, F.lit(" | "), F.array_join(own, " | "), F.lit(" |")).alias("line")))

    rows = rows.withColumn("folds", F.filter(F.transform("full", fold), lambda f: f.isNotNull()))

    def written(x: Column, i: Column) -> Column:
        gone = F.exists("folds", lambda f: (f["heading"] == i) | (f["row"] == i))
        return F.when(gone, F.array().cast("array<string>")).otherwise(F.concat(F.array(x), F.transform(F.filter("folds", lambda f: f["below"] == i), lambda f: f["line"])))

    text = F.when(F.size("folds") == 0, F.col("text")).otherwise(F.array_join(F.flatten(F.transform("lines", written)), "\n"))
    return rows.select("id", text.alias("text"), F.size("folds").cast("long").alias("rows"))


def header_restored(docs: DataFrame) -> DataFrame:
    """(id, text, headers): tables whose header lost its first cell get an empty one, in the separator too.

    Every data row must be one cell wider than the header (of two cells or
    more, above its separator), begin with something that is no value and end
    with one. Without such a table the text stays as it is.
    """
    rows = _blocks(docs.select("id", "text"))
    value = lambda c: F.coalesce(c.rlike(VALUE), F.lit(False))
    short = lambda b: (b["sep"] > b["start"]) & (b["header"] >= 2) & (F.size(b["data"]) > 0) & F.forall(b["data"], lambda r: (cells(r) == b["header"] + 1) & value(F.element_at(_cells_of(r), -1)) & ~value(F.get(_cells_of(r), F.lit(0))))
    rows = rows.withColumn("short", F.transform(F.filter("blocks", short), lambda b: b["sep"]))
    padded = lambda x: F.concat(F.lit("|  | "), F.array_join(_cells_of(x), " | "), F.lit(" |"))
    made = F.transform("lines", lambda x, i: F.when(F.array_contains("short", i) | F.array_contains("short", i + 1), padded(x)).otherwise(x))
    text = F.when(F.size("short") == 0, F.col("text")).otherwise(F.array_join(made, "\n"))
    return rows.select("id", text.alias("text"), F.size("short").cast("long").alias("headers"))


def repaired(docs: DataFrame) -> DataFrame:
    """(id, text): charts made text, edge pipes restored, blocks without header merged, split rows put back, headers made whole, in this order.

    Each step is a pass over the lines of one row; a null text is empty.
    """
    step = neutralised(docs).select("id", edge_pipes("text").alias("text"))
    return header_restored(reattached(merged(step))).select("id", "text")


def widest_header(c: str) -> Column:
    """Most cells of a row right above a strict separator; 0 without one."""
    each = F.transform(lines(c), js_trim)
    heads = F.filter(each, lambda x, i: x.rlike(rf"^\|{JS_DOT}*\|[{JS_SPACE}]*$") & F.coalesce(F.get(each, i + 1).rlike(STRICT_SEPARATOR), F.lit(False)))
    return F.coalesce(F.array_max(F.transform(heads, cells)), F.lit(0)).cast("long")


def malformed_examples(c: str, most: int = 2) -> Column:
    """The first lines with two pipes or more that are no rows, cut at 70 UTF-16 units; separators are not left out."""
    pipes = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    bad = F.filter(F.transform(lines(c), js_trim), lambda x: ~x.rlike(rf"^\|{JS_DOT}*\|[{JS_SPACE}]*$") & (pipes(x) >= 2))
    shown = lambda x: F.when(F.length(clipped(x, 70)) < F.length(x), F.concat(clipped(x, 70), F.lit("…"))).otherwise(x)
    return F.transform(F.slice(bad, 1, most), shown)


#: What a second look at a chunk is told of its tables.
NOTE_ROWS = ("%d line(s) carry table cells but are NOT well-formed GFM rows%s. ", "Every row of a table must start with `|`, end with `|`, and have EXACTLY as many cells as its header. ", "Do not merge separate columns into one cell and do not leave a column label dangling inside a bold line.")
NOTE_WIDE = ("A table header has %d columns — that is a chart axis or decorative row, not data. ", "Do NOT emit it as a table; keep its labels as plain text lines.")


def screened(docs: DataFrame) -> DataFrame:
    """(id, malformed, examples, widest, repair, note) of each chunk: whether its tables need a second look, and what is to be said of them."""
    out = docs.select("id", malformed_lines("text").alias("malformed"), F.array_join(malformed_examples("text"), "` / `").alias("examples"), widest_header("text").alias("widest"))
    shown = F.when(F.col("examples") == "", "").otherwise(F.concat(F.lit(", e.g. `"), "examples", F.lit("`")))
    rows = F.when(F.col("malformed") > 0, F.format_string("".join(NOTE_ROWS), "malformed", shown))
    wide = F.when(F.col("widest") >= CHART_CELLS, F.format_string("".join(NOTE_WIDE), "widest"))
    return out.withColumn("repair", (F.col("malformed") > 0) | (F.col("widest") >= CHART_CELLS)).withColumn("note", F.concat_ws(" ", rows, wide))


def without_noise(c: Column) -> Column:
    """Text without the lines extraction leaves, blanks at line ends and more than one blank line in a row; trimmed."""
    out = F.coalesce(c, F.lit(""))
    for p in NOISE:
        out = F.regexp_replace(out, f"(?iumd){p}", "")
    return js_trim(F.regexp_replace(F.regexp_replace(out, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def best_extraction(docs: DataFrame) -> DataFrame:
    """(id, source, reason) from (id, digital, ocr): recognised text is taken only for a corrupted layer and if it reads as prose.

    Row by row: ids may repeat, nulls read as empty, nothing is shuffled.
    """
    def trimmed(c: str) -> Column:
        return F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$", "")

    rows = docs.select("id", trimmed("digital").alias("digital"), trimmed("ocr").alias("ocr"))
    words = F.regexp_extract_all("ocr", F.lit(r"\p{L}+"), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1))
    share = lambda f: F.size(F.filter(words, f)) / n
    length = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)) / n
    reads = (length >= PROSE_LENGTH) & (share(lambda w: F.length(w) == 1) <= PROSE_SINGLE) & (share(lambda w: F.length(w) <= 2) <= PROSE_SHORT)
    judged = corrupted(rows, ["id", "ocr"], bad_digital=F.col("digital"), bad_ocr=F.col("ocr")).select("id", "bad_digital", "bad_ocr", (F.length("ocr") < 10).alias("little"), reads.alias("reads"))
    reason = F.when(F.col("little"), "ocr-unusable").when(~F.col("bad_digital"), "clean-layer-kept").when(F.col("bad_ocr"), "ocr-unusable").when(~F.col("reads"), "ocr-not-prose").otherwise("ocr-clean-recovery")
    return judged.select("id", F.when(reason == "ocr-clean-recovery", "ocr").otherwise("digital").alias("source"), reason.alias("reason"))


def refreshed(stored: Column, fresh: Column) -> Column:
    """Whether fresh text replaces the stored one: that is short or a placeholder, or the fresh one is long enough and differs."""
    old, new = js_trim(F.coalesce(stored, F.lit(""))), F.coalesce(fresh, F.lit(""))
    return (F.length(old) < 15) | F.contains(old, F.lit("[No raw text extracted]")) | ((F.length(new) > 20) & (old != new))


#: Fixed value: UTF-16 units of a chunk.
CHUNK = 1400


def _pieces(line: str, most: int) -> list[str]:
    """A line in pieces of at most `most` units: up to the last space within them, if that lies in their second half, without spaces at the start of the next."""
    out, units = [], line.encode("utf-16-le", "surrogatepass")
    while len(units) > 2 * most:
        head = units[: 2 * most + 2].decode("utf-16-le", "ignore")
        at = len(head[: head.rfind(" ")].encode("utf-16-le")) // 2 if " " in head else -1
        at = most if at < most / 2 else at
        out.append(units[: 2 * at].decode("utf-16-le", "ignore"))
        units = units[2 * at :].decode("utf-16-le", "ignore").lstrip(" ").encode("utf-16-le", "surrogatepass")
    return [*out, units.decode("utf-16-le", "ignore")] if units else out


_TRIM = f"^[{_PY_SPACE}]+|[{_PY_SPACE}]+$"


def chunked(text: str | None, most: int = CHUNK) -> list[str]:
    """A text in chunks of whole lines, of at most `most` units each, trimmed; a short or null text is one chunk."""
    text = text or ""
    size = lambda x: len(x) + len(re.findall("[\U00010000-\U0010ffff]", x))
    if size(text) <= most:
        return [text]
    out, held, units = [], [], 0
    for line in re.split(r"\r?\n", text):
        for piece in _pieces(line, most) if size(line) > most else [line]:
            if units and units + size(piece) + 1 > most:
                out.append(re.sub(_TRIM, "", "\n".join(held) + "\n"))
                held, units = [], 0
            held.append(piece)
            units += size(piece) + 1
    last = re.sub(_TRIM, "", "\n".join(held))
    return [*out, last] if last else out


def chunks(docs: DataFrame, most: int = CHUNK) -> DataFrame:
    """(id, chunk, text) of (id, text): the text in chunks, numbered from 0; row by row, as lines are dealt one after the other."""
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield texts.map(lambda t: chunked(t, most))

    return docs.select("id", F.posexplode(F.pandas_udf(run, "array<string>")(F.coalesce("text", F.lit("")))).alias("chunk", "text"))


def open_table(c: str) -> Column:
    """(header, separator) of the table in which a text ends, so that the next chunk may go on with it; null if it ends in none.

    The last line that isn't blank must be a row but no separator, and the
    rows right above must hold a separator with a header row over it.
    """
    trimmed = F.transform(lines(c), js_trim)
    full = F.filter(F.transform(trimmed, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    end = F.try_element_at(full, F.lit(-1))
    not_row = F.array_max(F.filter(F.transform(trimmed, lambda x, i: F.when(~x.rlike(ROW) & (i < end), i)), lambda i: i.isNotNull()))
    start = F.coalesce(not_row + 1, F.lit(0))
    seps = F.filter(F.transform(trimmed, lambda x, i: F.when(x.rlike(STRICT_SEPARATOR) & (i >= start) & (i <= end), i)), lambda i: i.isNotNull())
    sep = F.array_max(seps)
    head = F.get(trimmed, sep - 1)
    tail = F.get(trimmed, end)
    return F.when((F.size(full) > 0) & tail.rlike(ROW) & ~tail.rlike(STRICT_SEPARATOR) & (sep > 0) & head.rlike(ROW), F.struct(head.alias("header"), F.get(trimmed, sep).alias("separator")))


def joined(parts: DataFrame) -> DataFrame:
    """(id, text) of (id, chunk, text): chunks in their order, a blank line between them, but one line end where a table goes on.

    It goes on where a chunk ends with a row and the next begins like one.
    A document's chunks meet in one row, as its text does.
    """
    ordered = parts.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]).alias("c"))
    end = lambda x: F.element_at(F.split(F.regexp_replace(x, f"[{JS_SPACE}]+$", ""), r"\r?\n", -1), -1)
    start = lambda x: F.get(F.split(F.regexp_replace(x, f"^[{JS_SPACE}]+", ""), r"\r?\n", -1), F.lit(0))
    goes_on = lambda x, i: F.coalesce(end(F.get("c", i - 1)).rlike(rf"^\|{JS_DOT}*\|[{JS_SPACE}]*$"), F.lit(False)) & start(x).rlike(rf"^\|{JS_DOT}*\|")
    return ordered.select("id", F.array_join(F.transform("c", lambda x, i: F.concat(F.when(i == 0, "").when(goes_on(x, i), "\n").otherwise("\n\n"), x)), "").alias("text"))
