"""Retrieval, plans, chunks, repairs, images and streams against SQL, and named cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import images as I
from quarry.functions import json_text as J
from quarry.further_queries import ORACLE_SQL, QUERIES
from quarry.operators import repairs as M
from quarry.operators import taxonomy as X
from quarry.plans import retrieval as Y
from quarry.plans import search as P
from quarry.sources import registry as R
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_normalised():
    assert P.normalised((" rib ", "RIB", "???", "-", "é")) == ("rib", "é")
    assert P.Query(keywords=("???", " ")).facets() == []


def test_heuristic():
    assert Y.heuristic("relevé de compte 2023", ("Relevé",)) == P.Query(entities=("relevé",), keywords=("compte",), date_from="2023-01-01", date_to="2023-12-31")
    assert [P.asked_for(x) for x in ("2 derniers", "trois fiches", "25 documents", "last one", "rien")] == [2, 3, None, 1, None]


def test_index_is_rebuilt(spark, tmp_path):
    docs = R.registry(spark, SF)
    path = str(tmp_path / "index")
    P.write_index(docs.limit(0), path)
    query = P.Query(doc_types=("relevé de compte",), entities=("bnp", "edf"))
    index = P.open_index(docs, path)
    want = [tuple(r) for r in P.search(docs, query, 50).collect()]
    assert [tuple(r) for r in P.search_index(index, query, 50).collect()] == want and want
    assert P.search_index(index, P.Query(keywords=("zzqx",))).count() == 0
    assert P.search(docs.limit(0), query).count() == 0


def test_pay_periods(spark):
    rows = [(10, "housing", "2024-01-01"), (11, "housing", "2024-01-02"), (20, "Bulletin_Salaire", "2024-01-03"), (21, "bulletin_salaire", "15/01/2024"), (22, "bulletin_salaire", "2024-02-01"), (23, "bulletin_salaire", ""), (24, "bulletin_salaire", "")]
    got = Y.one_per_period(spark.createDataFrame(rows, "id long, category string, date string")).collect()
    assert sorted(r["id"] for r in got) == [10, 11, 21, 22, 23, 24]


@pytest.mark.parametrize(("text", "want"), [("", ""), ("a\n\n# Base\n| 1 | 2 |", None), (None, "")])
def test_repair_leaves_other_text(spark, text, want):
    got = M.repaired(spark.createDataFrame([(1, text)], "id long, text string")).first()["text"]
    assert got == (text if want is None else want)


def test_repair_order(spark):
    text = "| a | b | c |\n|---|---|---|\n x | 1 | 2\n\n## Base  du 01/02/26\n\n| 9,16 | 31 |\n"
    got = M.repaired(spark.createDataFrame([(1, text)], "id long, text string")).first()["text"]
    assert got == "| a | b | c |\n|---|---|---|\n| x | 1 | 2 |\n| Base du 01/02/26 | 9,16 | 31 |\n\n\n"


def test_chunks_lose_nothing(spark):
    r = random.Random(4)
    words = lambda n: " ".join("".join(r.choice("abé🙂") for _ in range(r.randrange(1, 12))) for _ in range(n))
    texts = ["\n".join(words(r.randrange(0, 400)) for _ in range(r.randrange(1, 12))) for _ in range(20)] + ["x" * 5000, "", None, "a" * 1400, " " * 3000]
    units = lambda x: len(x.encode("utf-16-le")) // 2
    for x in texts:
        parts = M.chunked(x)
        assert "".join("".join(parts).split()) == "".join((x or "").split())
        assert all(units(p) <= 1400 for p in parts)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for row in M.chunks(rows).orderBy("chunk").collect():
        got.setdefault(row["id"], []).append(row["text"])
    assert got == {i: c for i, x in enumerate(texts) if (c := M.chunked(x))}


JSONS = [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2,],}\n``` done', {"a": [1, 2]}), ('text {"a": "x}', {"a": "x}"}), ('{"a": {"b": ["c", "d', {"a": {"b": ["c", "d"]}}), ('{"a": "\\"[", "b": [', {"a": '"[', "b": []}), ("no json", None), ("", None), (None, None), ('{"a": }', None), ('{"a": 1} tail } x', None), ('{"k": "v"} end', {"k": "v"}),
]


def test_tolerant_json(spark):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(JSONS)], "id int, x string").repartition(2)
    got = {r["id"]: r["j"] and json.loads(r["j"]) for r in rows.select("id", F.to_json(J.tolerant_json(F.col("x"))).alias("j")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(JSONS)}


def test_export(spark, tmp_path):
    docs = R.registry(spark, SF)
    R.export_csv(docs, str(tmp_path / "csv"), category="bank")
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("part-*")))
    lines = text.split("\r\n")
    assert lines[0].startswith('\ufeff"ID","Checksum","Title"') and lines[-1] == "" and len(lines) == 2 + docs.where("lower(category) = 'bank'").count()
    ids = [int(x.split(",")[0].strip('"')) for x in lines[1:] if x[:1] == '"' and x[1:2].isdigit()]
    assert ids == sorted(ids, reverse=True) and ids


def test_lookup(spark):
    docs = R.registry(spark, SF)
    assert [r["id"] for r in R.lookup(docs, 3).collect()] == [3] and R.lookup(docs, checksum="none").count() == 0


@pytest.mark.parametrize(("content", "size", "tag"), [(None, None, None), (b"", None, None), (b"\xff\xd8\xff", None, None), (I.PNG + b"\0\0\0\rIHDR" + (5).to_bytes(4, "big") + (7).to_bytes(4, "big"), (5, 7), None), (b"\xff\xd8\xff\xff\xc0\0\x11\x08\0\x02\0\x03\x03", (3, 2), None), (b"\xff\xd8\xff\xe0\0\x01" + b"\0" * 20, None, None)])
def test_image_headers(content, size, tag):
    assert I.size_of(content) == size and I.orientation_of(content) == tag


def test_overlay_keyword_that_ends_in_a_digit(spark):
    from quarry.operators.classify import overlay_rule

    rows = spark.createDataFrame([("facture n° 12",), ("n° 1",), ("restage",), ("navigo",), ("navigos",)], "c string")
    got = [r["k"] for r in rows.select(overlay_rule(F.lit(""), F.col("c"))["keyword"].alias("k")).collect()]
    assert got == ["n° 1", "n° 1", None, "navigo", None]


PATHS = [(("C:/raws/facture.pdf", "invoices", "sfr", "2024-05-12", "x"), "root/invoices/sfr/2024/facture.pdf"), (("a", "administrative", "2023", "2024-01-01", ""), "root/administrative/general/2024/doc.pdf"), (("img001.jpg", "invoices", "sfr", "2024-05-12", "Facture Mai 2024 été!"), "root/invoices/sfr/2024/2024-05-12_Sfr_Facture_Mai_Ete.jpg"), (("scan", None, " a/B c ", None, "Sfr"), "root/other/a/b_c/2026/2026-02-01_ABC_Sfr.pdf")]


def test_canonical_paths(spark):
    names = ["facture.pdf", "doc.pdf", "img001.jpg", "scan"]
    rows = [(i, n, p[0][1], p[0][2], p[0][3], p[0][4]) for i, (n, p) in enumerate(zip(names, PATHS, strict=True))]
    docs = spark.createDataFrame(rows, "id int, original_filename string, category string, subcategory string, date string, title string")
    got = {r["id"]: r["path"] for r in X.canonical_paths(docs, "root", "2026-02-01").collect()}
    assert got == {i: p[1] for i, p in enumerate(PATHS)}
