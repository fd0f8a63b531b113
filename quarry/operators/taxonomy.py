"""Taxonomy reconciliation, feedback rules and canonical paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import FORBIDDEN, compare_slug, extension, fold, forbidden_subcategory, generic_filename, re2, similarity, slug

#: A small taxonomy in order: category, subcategory, aliases.
TAXONOMY = [("invoices", "sfr", ["red by sfr"]), ("invoices", "edf", ["electricite de france"]), ("invoices", "bouygues_telecom", []), ("housing", "foncia", ["foncia paris"]), ("bank", "bnp_paribas", ["bnp"]), ("bank", "boursobank", ["boursorama"]), ("health", "lai_dental", []), ("administrative", "navigo", []), ("administrative", "edf", [])]
#: Fixed value: the least similarity of names that conflict.
NEAR = 0.82


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TAXONOMY)], "ord int, category string, subcategory string, aliases array<string>")


def subcategory_conflicts(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """(category, subcategory, kind, to_category, to_subcategory, percent): what each proposed pair collides with, if anything.

    An equal name under the same category is no conflict. An equal name
    elsewhere goes before an alias, an alias before a near name. Names meet
    only where their lengths allow the similarity: each is filed under the
    lengths it may be compared with, which turns the fuzzy join into an equal one.
    """
    p = proposed.select("category", "subcategory", compare_slug(F.col("subcategory")).alias("s")).where("s <> ''")
    names = known.select("ord", F.col("category").alias("to_category"), F.col("subcategory").alias("to_subcategory"), F.explode(F.concat(F.array(F.struct(F.lit(0).alias("alias"), F.col("subcategory").alias("name"))), F.transform("aliases", lambda a: F.struct(F.lit(1).alias("alias"), a.alias("name"))))).alias("n"))
    names = names.select("ord", "to_category", "to_subcategory", "n.alias", compare_slug(F.col("n.name")).alias("t")).withColumn("len", F.length("t"))
    n = F.length("s")
    wide = p.withColumn("len", F.explode(F.sequence(F.floor(n * NEAR).cast("int"), F.ceil(n / NEAR).cast("int"))))
    met = wide.join(names, "len").withColumn("r", similarity(F.col("s"), F.col("t")))
    same = (F.col("s") == F.col("t")) & (F.col("alias") == 0)
    rank = F.when(same, 0).when(F.col("s") == F.col("t"), 1).when((F.col("r") >= NEAR) & (n >= 4) & (F.col("len") >= 4), 2)
    kind = F.when(F.col("rank") == 0, "cross-category").when(F.col("rank") == 1, "alias").otherwise("near")
    ranked = met.withColumn("rank", rank).where("rank IS NOT NULL").withColumn("own", (same & (F.col("category") == F.col("to_category"))))
    first = Window.partitionBy("category", "subcategory")
    best = ranked.withColumn("known", F.max("own").over(first)).where("NOT known").withColumn("i", F.row_number().over(first.orderBy("rank", F.desc("r"), "ord")))
    return best.where("i = 1").select("category", "subcategory", kind.alias("kind"), "to_category", "to_subcategory", F.round(F.col("r") * 100).cast("long").alias("percent"))


def canonical_owner(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(category, subcategory, owner): the category itself if it owns the subcategory, else its only owner, else null."""
    owners = known.groupBy("subcategory").agg(F.sort_array(F.collect_set("category")).alias("owners"))
    own = F.when(F.array_contains("owners", F.col("category")), F.col("category")).when(F.size("owners") == 1, F.get("owners", F.lit(0)))
    return rows.join(owners, "subcategory", "left").select("category", "subcategory", own.alias("owner"))


def merge_subcategory(known: DataFrame, category: str, old: str, new: str) -> DataFrame:
    """The taxonomy with old merged into new: their aliases and the old name as aliases of new."""
    t = F.when((F.col("category") == category) & (F.col("subcategory") == old), new).otherwise(F.col("subcategory"))
    extra = F.when(t != F.col("subcategory"), F.concat(F.col("aliases"), F.array("subcategory"))).otherwise(F.col("aliases"))
    return known.select("category", t.alias("subcategory"), extra.alias("aliases")).groupBy("category", "subcategory").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("aliases")))), ",").alias("aliases"))


def derive_keywords(decisions: DataFrame, stopwords: list[str]) -> DataFrame:
    """(id, keywords): up to three words of file name and title, those in both first, else in order. stopwords is a parameter, without accents."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$") & ~fold(t).isin(stopwords))
    name = F.regexp_replace("original_filename", r"\.[^.]*$", "")
    rows = decisions.select("id", words(name).alias("a"), words(F.col("title")).alias("b"))
    every = F.array_distinct(F.concat("a", "b"))
    both = F.filter(every, lambda t: F.array_contains("a", t) & F.array_contains("b", t))
    ranked = F.concat(both, F.array_except(every, both))
    return rows.select("id", F.array_join(F.slice(ranked, 1, 3), ",").alias("keywords"))


def priority_rules(decisions: DataFrame, stopwords: list[str], most: int = 25) -> DataFrame:
    """(ord, id, category, subcategory, keywords) of the newest decisions that make a rule: enabled, with a category, a subcategory that says something, and keywords."""
    ok = decisions.where((F.coalesce("enabled", F.lit(1)) != 0) & (F.trim("category") != "") & ~forbidden_subcategory(F.col("subcategory")))
    made = ok.join(derive_keywords(ok, stopwords), "id").where("keywords <> ''")
    newest = made.orderBy(F.desc("id")).limit(most)
    return newest.select(F.row_number().over(Window.orderBy(F.desc("id"))).alias("ord"), "id", "category", "subcategory", "keywords")


def intelligent_name(today: str) -> Column:
    """The file name of a row (original_filename, title, category, subcategory, date): a generic one becomes date_Entity_Title if there is a title, another stays.

    The date is a whole one, else a year, else today; the entity is the
    subcategory, if it says something, else the category, each word with a
    capital; the title loses what isn't a letter, a digit, a space, _ or -,
    and words that date or entity hold, and has 45 characters at most.
    """
    trimmed = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    words = lambda c: F.filter(F.split(c, r"[/\\_\s-]+"), lambda w: w != "")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    slugged = lambda c: F.array_join(F.transform(words(c), capital), "")
    sub = F.when(forbidden_subcategory(F.col("subcategory")), "").otherwise(trimmed("subcategory"))
    cat = F.when(F.coalesce("category", F.lit("")) == "", "other").otherwise(trimmed("category"))
    entity = F.coalesce(F.nullif(slugged(sub), F.lit("")), F.nullif(slugged(cat), F.lit("")), F.lit("Document"))
    iso, year, date = re2(r"\b(20\d{2})[-/._]?(\d{2})[-/._]?(\d{2})\b"), re2(r"\b(20\d{2})\b"), F.coalesce("date", F.lit(""))
    stamp = F.when(date.rlike(iso), F.concat_ws("-", *(F.regexp_extract(date, iso, i) for i in (1, 2, 3)))).when(date.rlike(year), F.regexp_extract(date, year, 1)).otherwise(today)
    title = F.coalesce("title", F.lit(""))
    kept = F.filter(F.transform(words(F.trim(F.regexp_replace(fold(title), r"[^a-zA-Z0-9\s_-]", ""))), capital), lambda w: ~F.contains(stamp, F.lower(w)) & ~F.contains(F.lower(entity), F.lower(w)))
    said = F.when(F.size(kept) == 0, "Document").otherwise(F.array_join(kept, "_"))
    ext = F.coalesce(F.nullif(extension(F.col("original_filename")), F.lit("")), F.lit(".pdf"))
    name = F.concat_ws("_", stamp, entity, F.concat(F.substring(said, 1, 45), F.lower(ext)))
    return F.when((F.trim(title) != "") & generic_filename(F.col("original_filename")), name).otherwise(F.col("original_filename"))


def canonical_paths(docs: DataFrame, root: str, today: str) -> DataFrame:
    """(id, path): root/category/subcategory/year/file of each row; the year of today stands where the date has none.

    A subcategory may have several parts; no subcategory and a year as one are
    general, blanks alone are none. The file name is intelligent_name(). Row by row; ids may repeat.
    """
    segment = lambda c, rest: F.coalesce(F.nullif(F.regexp_replace(slug(c), "^[_.-]+|[_.-]+$", ""), F.lit("")), F.lit(rest))
    cat = F.when(F.coalesce("category", F.lit("")) == "", "other").otherwise(F.lower(F.trim("category")))
    sub = F.when(F.coalesce("subcategory", F.lit("")) == "", "general").otherwise(F.lower(F.trim("subcategory")))
    sub = F.when(sub.rlike(r"^\d{4}$"), "general").otherwise(sub)
    parts = F.transform(F.filter(F.split(sub, r"[/\\]+"), lambda x: x != ""), lambda x: segment(x, "general"))
    found = F.regexp_extract(F.coalesce("date", F.lit("")), re2(r"\b(20\d{2})\b"), 1)
    year = F.when(found == "", today[:4]).otherwise(found)
    return docs.select("id", F.array_join(F.concat(F.array(F.lit(root), segment(cat, "other")), parts, F.array(year, intelligent_name(today))), "/").alias("path"))


def merge_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """(category, subcategory, origin): a public taxonomy and what a private one adds to it, without subcategories that say nothing."""
    added = overlay_diff(overlay, base).withColumn("origin", F.lit("private"))
    both = base.select("category", "subcategory").withColumn("origin", F.lit("public")).unionByName(added)
    return both.where(~forbidden_subcategory(F.col("subcategory")))


def overlay_diff(saved: DataFrame, public: DataFrame) -> DataFrame:
    """(category, subcategory) of a saved taxonomy that the public one lacks: new categories whole, of known ones the new subcategories."""
    pair = ["category", "subcategory"]
    return saved.select(*pair).dropDuplicates().join(public.select(*pair), pair, "left_anti")


def ensure_categories(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """The categories with those wanted that they lack."""
    have = known.select("category").dropDuplicates()
    return have.unionByName(wanted.select("category").dropDuplicates().join(have, "category", "left_anti"))


def category_conflicts(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """(category, kind, to_category, to_subcategory, percent): what each proposed category collides with, if anything.

    A near category goes first, then a subcategory of that name or near it: an
    entity is no category. A category that exists is not near itself. As with
    subcategories, names meet by the lengths that allow the similarity.
    """
    p = proposed.select("category").dropDuplicates().withColumn("raw", F.lower(F.trim("category"))).withColumn("s", compare_slug(F.col("raw"))).where("s <> ''")
    own = lambda c: ~forbidden_subcategory(F.col(c))
    cats = known.where(own("category")).groupBy("category").agg(F.min("ord").alias("ord")).select(F.lit(0).alias("rank"), "ord", F.col("category").alias("to_category"), F.lit("").alias("to_subcategory"), F.col("category").alias("name"))
    subs = known.where(own("subcategory")).select(F.lit(1).alias("rank"), "ord", F.col("category").alias("to_category"), F.col("subcategory").alias("to_subcategory"), F.col("subcategory").alias("name"))
    names = cats.unionByName(subs).withColumn("t", compare_slug(F.col("name"))).withColumn("len", F.length("t")).drop("name")
    n = F.length("s")
    wide = p.withColumn("len", F.explode(F.sequence(F.floor(n * NEAR).cast("int"), F.ceil(n / NEAR).cast("int"))))
    met = wide.join(names, "len").withColumn("r", similarity(F.col("s"), F.col("t")))
    near = (F.col("rank") == 0) & (F.col("s") != F.col("t")) & (n >= 4) & (F.col("r") >= NEAR)
    entity = (F.col("rank") == 1) & (F.col("r") >= NEAR)
    first = F.min_by(F.struct("rank", "to_category", "to_subcategory", "r"), F.struct("rank", -F.col("r"), "ord"))
    best = met.where(near | entity).groupBy("category").agg(first.alias("b"))
    return best.select("category", F.when(F.col("b.rank") == 0, "category-near").otherwise("entity-as-category").alias("kind"), "b.to_category", "b.to_subcategory", F.round(F.col("b.r") * 100).cast("long").alias("percent"))


def resolve_categories(rows: DataFrame, known: list[tuple[str, list[str]]], table: DataFrame) -> DataFrame:
    """(id, category, state) of (id, category): the first known category whose id it is or of which it holds an alias, else the one it conflicts with, else itself as a new one.

    known, the categories in order with their aliases, is configuration and
    becomes one literal; conflicts are sought for distinct names alone.
    """
    raw = slug(F.when(F.coalesce("category", F.lit("")) == "", "administrative").otherwise(F.col("category")))
    named = rows.select("id", raw.alias("category"))
    entry = lambda c, names: F.struct(F.lit(c).alias("c"), F.array(*(slug(F.lit(a)) for a in names)).cast("array<string>").alias("a"))
    listed = F.array(*(entry(c, names) for c, names in known))
    hit = lambda e: (e["c"] == F.col("category")) | F.exists(e["a"], lambda a: F.contains(F.col("category"), a))
    named = named.withColumn("hit", F.get(F.filter(listed, hit), F.lit(0))["c"])
    open_names = named.where("hit IS NULL").select("category").distinct()
    clash = category_conflicts(open_names, table).select("category", "to_category")
    out = named.join(clash, "category", "left")
    state = F.when(F.col("hit").isNotNull(), "known").when(F.col("to_category").isNotNull(), "conflict").otherwise("new")
    return out.select("id", F.coalesce("hit", "to_category", "category").alias("category"), state.alias("state"))


def changed_decisions(edits: DataFrame) -> DataFrame:
    """Edits that are recorded: those after which category or subcategory differs in more than the case of letters."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return edits.where((low("old_category") != low("new_category")) | (low("old_subcategory") != low("new_subcategory")))


def renamed(docs: DataFrame, category: str, old: str, new: str) -> DataFrame:
    """(id, category, subcategory) after a subcategory got another name; letters of either case are equal."""
    same = (F.lower("category") == category.lower()) & (F.lower("subcategory") == old.lower())
    return docs.select("id", "category", F.when(same, new).otherwise(F.col("subcategory")).alias("subcategory"))


def moves(docs: DataFrame, root: str, today: str) -> DataFrame:
    """(id, new_path, path) of rows whose file is not where its canonical path says; a plan, no file is moved."""
    tidy = lambda c: F.lower(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+", "/"))
    both = docs.select("id", "new_path").join(canonical_paths(docs, root, today), "id")
    return both.where(tidy(F.col("new_path")) != tidy(F.col("path")))


def numbered(files: DataFrame, suffix: str) -> DataFrame:
    """(id, name, unique_name): of each name the first by id keeps it, the others get the suffix and a number before the extension."""
    i = F.row_number().over(Window.partitionBy("name").orderBy("id")) - 1
    ext = extension(F.col("name"))
    stem = F.substr("name", F.lit(1), F.length("name") - F.length(ext))
    return files.withColumn("i", i).select("id", "name", F.when(F.col("i") == 0, F.col("name")).otherwise(F.concat(stem, F.lit(f"_{suffix}"), F.col("i").cast("string"), ext)).alias("unique_name"))


def composed_rules(curated: DataFrame, learned: DataFrame) -> DataFrame:
    """(ord, category, subcategory, keywords, origin): curated rules (ord, ...) in their order, those learned from decisions after them."""
    both = curated.select(F.lit(0).alias("o"), "ord", "category", "subcategory", "keywords").unionByName(learned.select(F.lit(1).alias("o"), "ord", "category", "subcategory", "keywords"))
    return both.select(F.row_number().over(Window.orderBy("o", "ord")).alias("ord"), "category", "subcategory", "keywords", F.when(F.col("o") == 0, "curated").otherwise("learned").alias("origin"))


#: The block of hints, and its line for each.
HINTS = ("STEP 0: TAXONOMY DUPLICATE GUARD (read BEFORE classifying):", "- The following category/subcategory slugs were proposed by a previous run but BLOCKED because an identical or near-identical instance already exists. NEVER return them as new categories/subcategories — always reuse the exact existing slug under its existing category:")


def hint_lines(hints: DataFrame) -> DataFrame:
    """(ord, line) of hints (ord, proposed_category, proposed_subcategory, mapped_category, mapped_subcategory, hint) that name a category and say something."""
    joined = lambda a, b: F.array_join(F.filter(F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), lambda x: x != ""), "/")
    proposed = F.coalesce(F.nullif(joined("proposed_category", "proposed_subcategory"), F.lit("")), F.lit("?"))
    told = hints.where("coalesce(mapped_category, '') <> '' AND coalesce(hint, '') <> ''")
    return told.select("ord", F.format_string('- "%s" → ALWAYS use "%s". %s', proposed, joined("mapped_category", "mapped_subcategory"), "hint").alias("line"))


def narrow_forbidden(c: Column) -> Column:
    """Whether a subcategory is one of the words that name none, as it stands."""
    return F.coalesce(c.isin(FORBIDDEN), F.lit(False))


def generic_category(c: Column) -> Column:
    """Whether a category, trimmed and in letters of either case, is empty or says nothing."""
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "general", "other", "divers")
