"""Every query over files and repairs against its SQL, and the operators' named cases."""

import functools
import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.file_queries import NAMES, ORACLE_SQL, QUERIES
from quarry.functions import paths as N
from quarry.operators import repairs as M
from quarry.sources import files as S
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_natural_order(spark):
    def before(a, b):
        def parts(x):
            return [(0, int(t), "") if t[0].isdigit() else (1, 0, t.lower()) for t in re.findall("[0-9]+|[^0-9]+", x)]

        return (parts(a) > parts(b)) - (parts(a) < parts(b))

    got = [r["x"] for r in QUERIES["natural_order"](spark, SF).collect()]
    assert got == sorted(NAMES, key=functools.cmp_to_key(before))


def test_read_tree(spark, tmp_path):
    for name in ("a/x.pdf", "a/y.exe", "duplicates/z.pdf", "b.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"some text here")
    root = str(tmp_path)
    files = S.scan(S.read_tree(spark, root), root)
    assert sorted((r["path"][len(root) :], r["size"]) for r in files.collect()) == [("/a/x.pdf", 14), ("/b.txt", 14)]
    text = S.extracted(S.read_tree(spark, root, content=True).where("path LIKE '%txt'")).first()
    assert (text["text"], len(text["checksum"])) == ("some text here", 64)


def test_write_package(spark):
    rows = spark.createDataFrame([("a.pdf", b"1"), ("a.pdf", b"2"), ("", b"3"), ("gone", None)], "name string, content binary").coalesce(1)
    out = io.BytesIO()
    assert S.write_package(rows, out) == 3
    archive = zipfile.ZipFile(out)
    assert {n: archive.read(n) for n in archive.namelist()} == {"a.pdf": b"1", "a_2.pdf": b"2", "document.pdf": b"3"}


def test_clipped(spark):
    rows = spark.createDataFrame([("ab",), ("a\U0001f600b",), ("",), (None,)], "x string")
    assert [r[0] for r in rows.select(N.clipped(F.col("x"), 2)).collect()] == ["ab", "a", "", None]


def test_merge_keeps_what_it_must(spark):
    rows = spark.createDataFrame([(1, "| a |\r\n|---|\r\n\r\n| b |"), (2, None), (3, ""), (4, "| a |\n| b |")], "id long, text string")
    assert {r["id"]: (r["text"], r["blocks"]) for r in M.merged(rows).collect()} == {1: ("| a |\n|---|\n| b |", 1), 2: (None, 0), 3: ("", 0), 4: ("| a |\n| b |", 0)}


def test_empty(spark):
    files = spark.createDataFrame([], "path string, size long")
    assert S.image_bundles(files, "r").count() == 0
    assert S.directory_stats(files).collect() == [] or S.directory_stats(files).first()["n"] == 0
    assert M.screened(spark.createDataFrame([], "id long, text string")).count() == 0
