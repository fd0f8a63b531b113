"""Text cleaning and quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import JS_DOT, JS_SPACE, js_trim, once

#: Tokens that look mangled but are units.
UNITS = "kW kWh kVA kWc kWp kVAr kVar kV kB kHz kPa hPa cSt dBm cGy mGy mSv mV mA mW mAh mΩ kΩ μA μW µA µW".split()
#: The corruption scan's window, step, least words, least matches and least share.
WINDOW, STEP, LEAST_WORDS, LEAST_MATCHES, LEAST_SHARE = 100, 50, 60, 6, 0.08

#: Fixed value: the share of distinctive tokens that Markdown must keep.
LEAST_RECALL = 0.55


def clean(c: Column) -> Column:
    """Empty below 10 bytes; without NUL, with LF line ends, at most one blank line in a row, trimmed."""
    trim = lambda x: F.regexp_replace(x, r"^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$", "")
    text = F.coalesce(c, F.lit(""))
    tidy = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\x00"), F.lit("")), r"\r\n", "\n"), r"\n{3,}", "\n\n")
    return F.when(F.octet_length(trim(text)) < 10, "").otherwise(trim(tidy))


def no_text(c: Column) -> Column:
    return F.length(js_trim(F.coalesce(c, F.lit("")))) < 10


def prose(c: Column) -> Column:
    """Struct (tokens, score): average length of words less penalties for short ones; -1 without words."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\p{L}+"), F.lit(0))
    n = F.size(words)
    share = lambda f: F.size(F.filter(words, f)) / n
    total = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    score = total / n - 1.5 * share(lambda w: F.length(w) == 1) - 0.4 * share(lambda w: F.length(w) <= 2)
    return F.struct(n.cast("long").alias("tokens"), F.when(n == 0, F.lit(-1.0)).otherwise(F.round(score, 9)).alias("score"))


def _flags(text: Column) -> Column:
    """1 for each word of 2 to 8 characters with one capital that isn't the first, 0 for each other one that is no unit."""
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w).between(2, 8) & ~w.isin(UNITS))
    mangled = lambda w: (F.length(F.regexp_replace(w, r"[^\p{Lu}]", "")) == 1) & ~w.rlike(r"^\p{Lu}")
    return F.transform(words, lambda w: F.when(mangled(w), 1).otherwise(0))


def _worst(flags: Column) -> tuple[Column, Column]:
    """The windows of flags, and the worst (ratio, at, hits) of those that count as mangled, null if none does."""
    n = F.size(flags)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(STEP)), lambda s: n - s >= LEAST_WORDS)
    windows = F.transform(starts, lambda s: F.struct(F.least(F.lit(WINDOW), n - s).alias("size"), F.aggregate(F.slice(flags, s + 1, F.lit(WINDOW)), F.lit(0), lambda a, x: a + x).alias("hits"), (-s).alias("at")))
    good = F.filter(windows, lambda w: (w["hits"] >= LEAST_MATCHES) & (w["hits"] / w["size"] >= LEAST_SHARE))
    return windows, F.array_max(F.transform(good, lambda w: F.struct((w["hits"] / w["size"]).alias("ratio"), w["at"].alias("at"), w["hits"].alias("hits"))))


def corrupted(rows: DataFrame, keep: list[str], **texts: Column) -> DataFrame:
    """The columns keep of rows and, by name, whether each text is corrupted; row by row."""
    flagged = once(rows, keep, "_f", *(_flags(t).alias(n) for n, t in texts.items()))
    return flagged.select(*keep, *(_worst(F.col(f"_f.{n}"))[1].isNotNull().alias(n) for n in texts))


def corruption(docs: DataFrame) -> DataFrame:
    """(id, windows, ratio, matches, corrupted) from (id, text): the worst window of words with a capital inside.

    Words of 2 to 8 characters that are not units count. Windows start at
    every 50th word, the first of the worst counts. A row is a row throughout,
    ids may repeat, nothing is shuffled; a null text gives null windows.
    """
    flags = once(docs, ["id"], "f", _flags(F.col("text")).alias("flags"))
    windows, best = _worst(F.col("f.flags"))
    rows = once(flags, ["id"], "w", F.size(windows).cast("long").alias("windows"), best.alias("best")).select("id", "w.*")
    return rows.select("id", "windows", F.round(F.coalesce("best.ratio", F.lit(0.0)), 9).alias("ratio"), F.coalesce("best.hits", F.lit(0)).cast("long").alias("matches"), F.col("best").isNotNull().alias("corrupted"))


#: Fixed value: words that a report of corruption shows.
SAMPLES = 5


def mangled_words(text: Column) -> Column:
    """The first words that count as mangled, for a report."""
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w).between(2, 8) & ~w.isin(UNITS))
    return F.slice(F.filter(words, lambda w: (F.length(F.regexp_replace(w, r"[^\p{Lu}]", "")) == 1) & ~w.rlike(r"^\p{Lu}")), 1, SAMPLES)


def thin_layer(docs: DataFrame) -> DataFrame:
    """(id, thin, reason) from (id, text, pages): several pages that repeat a line or two, or hold next to nothing."""
    clean_text = F.regexp_replace("text", r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(clean_text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = docs.select("id", clean_text.alias("text"), F.greatest("pages", F.lit(1)).alias("pages"), lines.alias("lines"))
    own = F.array_distinct("lines")
    chars = F.aggregate(own, F.lit(0), lambda a, x: a + F.length(x))
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]{3,}"), F.lit(0))))
    able = (F.col("pages") >= 2) & (F.col("text") != "")
    same = able & (F.size("lines") >= F.col("pages")) & (F.size(own) <= 2) & (chars <= 200)
    low = able & (F.length("text") / F.col("pages") < 100) & (words / F.col("pages") < 10)
    return rows.select("id", (same | low).alias("thin"), F.when(same, "repeated-boilerplate").when(low, "low-density").otherwise("").alias("reason"))


def _tokens(c: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-zà-ÿ]{6,}|\d[\d.,]{2,}"), F.lit(0)))


def _recalled(own: Column, kept: Column, words: Column, chars: Column) -> list[Column]:
    """total, missing, recall, measurable of distinctive tokens, words and the length of the trimmed text."""
    lost = F.filter(F.array_except(own, kept), lambda t: (F.length(t) < 15) & (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))) < 2))
    n = F.greatest(F.size(words), F.lit(1))
    share = lambda f: F.size(F.filter(words, f)) / n
    fused = (chars / n >= 25) | (share(lambda w: F.length(w) >= 15) >= 0.35) | (share(lambda w: w.rlike("[a-zà-ÿ][A-ZÀ-Ý]")) >= 0.05)
    total, missing = F.size(own), F.size(lost)
    return [total.cast("long").alias("total"), missing.cast("long").alias("missing"), F.when(total == 0, 1.0).otherwise(F.round((total - missing) / total, 9)).alias("recall"), ((total >= 40) & ~fused).alias("measurable")]


def _recall_parts(raw: str, markdown: str) -> list[Column]:
    words = F.filter(F.split(js_trim(F.col(raw)), f"[{JS_SPACE}]+"), lambda w: w != "")
    return [_tokens(raw).alias("own"), _tokens(markdown).alias("kept"), words.alias("words"), F.length(js_trim(F.col(raw))).alias("chars")]


def recall(docs: DataFrame) -> DataFrame:
    """(id, total, missing, recall, measurable) from (id, raw, markdown): the share of distinctive tokens that the second text keeps. Row by row; ids may repeat."""
    rows = once(docs, ["id"], "x", *_recall_parts("raw", "markdown"))
    return once(rows, ["id"], "y", *_recalled(*(F.col(f"x.{c}") for c in ("own", "kept", "words", "chars")))).select("id", "y.*")


#: Rows and separators of tables.
ROW = rf"^[{JS_SPACE}]*\|{JS_DOT}*\|[{JS_SPACE}]*$"
SEPARATOR = rf"^[{JS_SPACE}]*\|[{JS_SPACE}:|-]+\|[{JS_SPACE}]*$"
STRICT_SEPARATOR = rf"^\|(?:[{JS_SPACE}]*:?-{{2,}}:?[{JS_SPACE}]*\|)+[{JS_SPACE}]*$"
MARKUP = r"^[>#*+\-]|^\d+\."


def lines(c: str) -> Column:
    return F.split(F.coalesce(c, F.lit("")), r"\r?\n", -1)


def _pipes(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))


def malformed_lines(c: str) -> Column:
    """Number of lines with two pipes or more that are neither a row nor a separator."""
    bad = lambda x: ~x.rlike(rf"^\|{JS_DOT}*\|$") & ~x.rlike(STRICT_SEPARATOR) & (_pipes(x) >= 2)
    return F.size(F.filter(F.transform(lines(c), js_trim), bad)).cast("long")


def edge_pipes(c: str) -> Column:
    """The text with the outer pipes of such lines restored, but for markup."""
    def fixed(x: Column) -> Column:
        t = js_trim(x)
        broken = (t != "") & ~t.rlike(rf"^\|{JS_DOT}*\|[{JS_SPACE}]*$") & ~t.rlike(STRICT_SEPARATOR) & ~t.rlike(MARKUP) & (_pipes(t) >= 2)
        out = F.concat(F.when(t.startswith("|"), "").otherwise("| "), t, F.when(t.endswith("|"), "").otherwise(" |"))
        return F.when(broken, out).otherwise(x)

    return F.array_join(F.transform(lines(c), fixed), "\n")


def cells(x: Column) -> Column:
    return F.size(F.split(F.regexp_replace(F.regexp_replace(js_trim(x), r"^\|", ""), r"\|$", ""), r"\|", -1))


def _rows_of(c: str) -> Column:
    """The table rows of a text as (ln, cells, sep)."""
    numbered = F.transform(lines(c), lambda x, i: F.struct(i.alias("ln"), x.alias("line")))
    return F.transform(F.filter(numbered, lambda s: s["line"].rlike(ROW)), lambda s: F.struct(s["ln"].alias("ln"), cells(s["line"]).alias("cells"), s["line"].rlike(SEPARATOR).alias("sep")))


def _blocks_of(rows: Column) -> Column:
    """Runs of table rows as (start, header, data_rows, ragged, headed).

    A run begins where a row doesn't follow the row before; the header is
    the row before the first separator, or the separator where it comes first.
    """
    line_at = lambda i: F.get(rows, i)["ln"]
    places = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
    firsts = F.filter(places, lambda i: (i == 0) | (line_at(i) - line_at(i - 1) > 1))
    runs = F.transform(firsts, lambda i, k: F.slice(rows, i + 1, F.coalesce(F.get(firsts, k + 1), F.size(rows)) - i))
    numbered = F.transform(runs, lambda r: F.struct(r.alias("r"), F.get(F.filter(r, lambda x: x["sep"]), F.lit(0))["ln"].alias("sep"), F.get(r, F.lit(0))["ln"].alias("start")))
    headed = F.transform(numbered, lambda x: F.struct(x["r"].alias("r"), x["sep"].alias("sep"), x["start"].alias("start"), F.get(x["r"], F.greatest(x["sep"] - 1, x["start"]) - x["start"])["cells"].alias("header")))

    def block(x: Column) -> Column:
        data = F.filter(x["r"], lambda r: (r["ln"] != x["sep"]) & (r["ln"] != x["sep"] - 1))
        count = lambda a: F.when(x["sep"].isNotNull(), F.size(a)).otherwise(0).cast("long")
        return F.struct(x["start"].cast("long").alias("start"), F.when(x["sep"].isNotNull(), x["header"]).cast("long").alias("header"), count(data).alias("data_rows"), count(F.filter(data, lambda r: r["cells"] != x["header"])).alias("ragged"), x["sep"].isNotNull().alias("headed"))

    return F.transform(headed, block)


def table_blocks(docs: DataFrame) -> DataFrame:
    """(id, start, header, data_rows, ragged, headed) of each run of table rows in (id, text). Found within the row; nothing is shuffled, ids may repeat."""
    rows = once(docs, ["id"], "x", _rows_of("text").alias("rows"))
    return rows.select("id", F.explode(_blocks_of(F.col("x.rows"))).alias("b")).select("id", "b.*")


def _audited(blocks: Column) -> list[Column]:
    """blocks, data_rows, ragged, headerless, worst_start; the worst block is the first with most ragged rows."""
    total = lambda c: F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + b[c])
    worst = F.array_max(F.transform(F.filter(blocks, lambda b: b["ragged"] > 0), lambda b: F.struct(b["ragged"].alias("n"), (-b["start"]).alias("at"))))
    return [F.size(blocks).cast("long").alias("blocks"), total("data_rows").alias("data_rows"), total("ragged").alias("ragged"), F.size(F.filter(blocks, lambda b: ~b["headed"])).cast("long").alias("headerless"), (-worst["at"]).alias("worst_start")]


def audit(docs: DataFrame) -> DataFrame:
    """(id, blocks, data_rows, ragged, headerless, worst_start) of the rows of (id, text) that hold table rows; ids may repeat."""
    rows = once(docs, ["id"], "x", _rows_of("text").alias("rows")).where(F.size("x.rows") > 0)
    return once(rows, ["id"], "y", _blocks_of(F.col("x.rows")).alias("blocks")).select("id", *_audited(F.col("y.blocks")))


def gate(docs: DataFrame) -> DataFrame:
    """(id, passed, failures) from (id, raw, markdown), row by row: ids may repeat, nulls read as empty, an empty table gives an empty one.

    Noise and corruption of the raw text; malformed lines, ragged rows, tables
    without header and lost content of the Markdown. Nothing is shuffled or joined.
    """
    texts = docs.select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("raw", "markdown")))
    found = once(texts, ["id"], "x", prose(F.col("raw")).alias("p"), _flags(F.col("raw")).alias("flags"), malformed_lines("markdown").alias("malformed"), _rows_of("markdown").alias("rows"), *_recall_parts("raw", "markdown"))
    read = once(found, ["id", "x.p", "x.malformed"], "y", _worst(F.col("x.flags"))[1].isNotNull().alias("corrupted"), _blocks_of(F.col("x.rows")).alias("blocks"), *_recalled(*(F.col(f"x.{c}") for c in ("own", "kept", "words", "chars"))))
    rows = once(read, ["id", "p", "malformed", "y.corrupted", "y.recall", "y.measurable"], "t", *_audited(F.col("y.blocks"))).select("*", "t.*")
    ragged = (F.col("ragged") >= 4) | ((F.col("data_rows") >= 6) & (F.col("ragged") / F.greatest("data_rows", F.lit(1)) >= 0.5))
    lost = F.col("measurable") & (F.col("recall") < LEAST_RECALL)
    tests = [("noise", (F.col("p.tokens") >= 50) & (F.col("p.score") <= 1)), ("corrupted", F.col("corrupted")), ("malformed", F.col("malformed") >= 4), ("ragged", ragged), ("headerless", F.col("headerless") >= 2), ("content-loss", lost)]
    failed = F.array_compact(F.array(*(F.when(t, n) for n, t in tests)))
    return rows.select("id", (F.size(failed) == 0).alias("passed"), F.array_join(failed, ",").alias("failures"))


def tables_of(c: Column, by: Column) -> Column:
    """Table lines dealt by an id, some ragged, some without header, put after a text."""
    cases = ["", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "| a | b |\n| --- | --- |\n| 1 |\n| 1 | 2 | 3 |\ntext\n| x | y |", "a | b | c\n- x | y | z\n| p | q", "| | |\n| 1 | 2 |\n\n| 7 | 8 |\n| 9 | 9 |", "| a | b | c |\n|:--|---|--:|\n" + "| 1 | 2 |\n" * 6]
    return F.concat(F.coalesce(c, F.lit("")), F.lit("\n"), F.element_at(F.array(*map(F.lit, cases)), (by % len(cases)).cast("int") + 1))
