"""Every registry query against its SQL, and the operators' named cases."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import quality as Q
from quarry.plans import search as P
from quarry.queries import ORACLE_SQL, QUERIES
from quarry.sources import registry as R
from quarry.streaming import events as Z
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def one(spark, value, f, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("x", "want"), [("Propriétaire", "proprietaire"), ("Crédit Mutuel / Springfield", "credit_mutuel_springfield"), ("  ", ""), ("œuvre", "uvre")])
def test_slug(spark, x, want):
    assert one(spark, x, T.slug) == want


@pytest.mark.parametrize(("x", "want"), [("a.JPG", "IMAGE"), (".bashrc", "PDF"), ("x.tif", "PDF"), ("d/n.md", "TEXT"), ("", "PDF"), ("b.xls", "EXCEL")])
def test_file_type(spark, x, want):
    assert one(spark, x, T.file_type) == want


@pytest.mark.parametrize(("x", "want"), [(None, True), ("2023", True), ("102818", True), ("verso_png", True), ("CamScanner 1", True), ("sfr", False), ("--", True)])
def test_forbidden(spark, x, want):
    assert one(spark, x, T.forbidden_subcategory) is want


@pytest.mark.parametrize(("x", "want"), [("2024-02-30", 19783), ("31/12/2023", 19722), ("2024-13-01", 0), ("vers 2022", 18993), ("", 0)])
def test_document_day(spark, x, want):
    assert one(spark, x, P.document_day) == want


@pytest.mark.parametrize(("x", "want"), [("last 2", 1), ("2 derniers", 2), ("trois fiches", 3), ("25 documents", None), ("rien", None)])
def test_requested_count(spark, x, want):
    assert one(spark, x, P.requested_count) == want


def test_ascii_word_boundary(spark):
    assert not one(spark, "santé ok", lambda c: c.rlike(T.re2(r"\b(santé)\b")))
    assert one(spark, "a sante ok", lambda c: c.rlike(T.re2(r"\b(sante)\b")))


@pytest.mark.parametrize(("x", "want"), [("", -1.0), ("ab c", 1.5 - 1.5 * 0.5 - 0.4)])
def test_prose(spark, x, want):
    assert one(spark, x, lambda c: Q.prose(c)["score"]) == pytest.approx(want)


def test_bm25_equals_sqlite(spark):
    import sqlite3

    rows = [(i, "tt" + str(i % 3), "alpha beta " * (i % 4) + "gamma " * i) for i in range(1, 30)]
    db = sqlite3.connect(":memory:")
    cols = list(P.WEIGHTS)
    db.execute(f"CREATE VIRTUAL TABLE f USING fts5({', '.join(cols)})")
    full = [{c: "" for c in cols} | {"title": t, "raw_text": x} for _, t, x in rows]
    db.executemany(f"INSERT INTO f(rowid, {', '.join(cols)}) VALUES ({', '.join('?' * (len(cols) + 1))})", [(i, *(r[c] for c in cols)) for (i, *_), r in zip(rows, full, strict=True)])
    weights = ", ".join(str(P.WEIGHTS[c]) for c in cols)
    want = db.execute(f"SELECT rowid, bm25(f, {weights}) FROM f WHERE f MATCH ?", ('("beta alpha" OR "tt1")',)).fetchall()
    docs = spark.createDataFrame([(i, *(r[c] for c in cols), "") for (i, *_), r in zip(rows, full, strict=True)], ["id", *cols, "date"])
    got = {r["id"]: r["score"] for r in P.search(docs, P.Query(entities=("beta alpha", "tt1")), 100).collect()}
    assert set(got) == {i for i, _ in want}
    assert all(got[i] == pytest.approx(s, abs=1e-8) for i, s in want)


def test_rate_limit(spark):
    rows = [(i, f"2024-01-01 00:{m:02d}:{s:02d}", 1, "error", 0.0, "") for i, (m, s) in enumerate([(0, 0), (0, 59), (1, 0), (1, 30), (2, 1)])]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp_ntz("ts"))
    assert sorted(r["event_id"] for r in Z.rate_limited(events).collect()) == [0, 2, 4]


def test_rate_limit_equals_sql_between_seconds(spark, tmp_path):
    """Rows as in the large tables, where whole seconds cut off and rounded differ: in the distance of two errors, in the order of two, and at exact halves."""
    import duckdb

    at = {
        1: ["15 23:11:29.746056", "16 23:11:29.406545", "17 07:22:14.911057"],
        2: ["15 03:04:26.618303", "15 03:04:26.140694", "17 00:23:44.691688"],
        3: ["15 00:00:00.500000", "16 00:00:00.499999", "16 00:00:01.500000", "17 00:00:00.500000", "17 00:00:02.500000", "18 00:00:01.500000"],
        4: ["15 00:00:01.500000", "15 00:00:02.500000", "16 00:00:02.499999", "16 00:00:02.000000"],
        5: [None, "15 00:00:00", "15 12:00:00", "16 00:00:00", None],
        6: [None, None],
        None: ["15 00:00:00", "17 00:00:00", None],
    }
    rows = [(-i, t and f"2024-01-{t}", u, "error", 0.0, "") for i, (u, t) in enumerate((u, t) for u, times in at.items() for t in times)]
    rows += [(None, "2024-01-15 00:00:00", 7, "error", 0.0, ""), (100, "2024-01-15 00:00:00", 7, "error", 0.0, ""), (None, "2024-01-16 00:00:00", 7, "error", 0.0, ""), (101, "2024-01-14 00:00:00", 7, "view", 0.0, "")]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = sorted((tuple(r) for r in QUERIES["rate_limit"](spark, str(tmp_path)).select("user_id", "event_id").collect()), key=repr)
    assert got == sorted(con.execute(ORACLE_SQL["rate_limit"]).fetchall(), key=repr)
    assert {e for u, e in got if u in (1, 2)} == {0, -2, -4, -5}


def test_streams_equal_batch(spark):
    batch = {tuple(r) for r in Z.sessions(Z.logs(spark.read.parquet(f"{SF}/events.parquet"))).collect()}
    assert {tuple(r) for r in Z.stream_sessions(spark, SF).collect()} == batch


def test_empty_table(spark):
    docs = spark.createDataFrame([], "id long, title string, original_filename string, original_path string, summary string, category string, subcategory string, tags string, raw_text string, date string, checksum string")
    docs = docs.withColumns({c: F.lit("") for c in {*R.LISTED, *P.WEIGHTS} - set(docs.columns)})
    assert P.search(docs, P.Query(keywords=("x",))).count() == 0
    assert R.listing(docs, q="x").count() == 0
    assert Q.audit(docs.select("id", F.col("raw_text").alias("text"))).count() == 0
