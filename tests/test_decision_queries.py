"""Classification, gate and blocked files against SQL, and named cases."""

import pytest
from pyspark.sql import functions as F

from quarry import decision_queries as W
from quarry.functions import text as T
from quarry.operators import quality as Q
from quarry.operators import grounding as G
from quarry.operators.decision import combined, decided
from quarry.decision_queries import ORACLE_SQL, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, SF), ORACLE_SQL[name])


@pytest.mark.parametrize("x", ["", "é" * 9, "a" * 5 + "🙂" * 9, "a🙂" * 9, "🙂" * 2, "a" * 6 + "🙂", "a" * 7 + "🙂"])
def test_head_units(spark, x):
    want = x.encode("utf-16-be")[:16].decode("utf-16-be", errors="ignore")
    assert spark.createDataFrame([(x,)], "x string").select(T.head_units(F.col("x"), 8)).first()[0] == want


def test_signal_is_the_start_of_the_text(spark):
    rows = [(8, "a.pdf", "navigo " + "x" * 3000), (28, "a.pdf", "y" * 3950 + " navigo " + "z" * 900), (48, "a.pdf", "y" * 5000 + " navigo")]
    docs = spark.createDataFrame(rows, "id long, original_filename string, raw_text string")
    assert sorted(r["id"] for r in W.C.overlay_match(W._first(docs), combined()).collect()) == [8, 28]


DECIDED = [
    ("x.pdf", "facture client n° 7 edf", "factures_clients", "edf"), ("x.pdf", "facture allianz", "insurance", "allianz"), ("x.pdf", "facture client", "factures_clients", "facture"),
    ("x.pdf", "carte grise, cession du véhicule", "identity", "carte_grise"), ("x.pdf", "récépissé", "identity", "recipisse_sejour"), ("x.pdf", "cni", "identity", "carte_identite"), ("x.pdf", "cnil", "administrative", "general"), ("x.pdf", "livret de famille", "identity", "general"),
    ("x.pdf", "attestation employeur", "contracts", "attestation_employeur"), ("x.pdf", "acte de société", "administrative", "general"), ("x.pdf", "acte de societe", "contracts", "statuts_societe"), ("x.pdf", "dossier-rempli", "administrative", "dossier_administratif"),
    ("x.pdf", "paystub", "bulletin_salaire", "employeur"), ("x.pdf", "wage statement edf", "bulletin_salaire", "edf"), ("x.pdf", "balance due", "invoices", "general"), ("x.pdf", "utility bill", "housing", "justificatif_domicile"), ("x.pdf", "relevé de chèques", "bank", "releve_bancaire"),
    ("x.pdf", "antai", "administrative", "amende"), ("x.pdf", "bnp", "bank", "bnp_paribas"), ("x.pdf", "formation sfr", "education", "sfr"), ("x.pdf", "mutuelle allianz", "health", "allianz"), ("x.pdf", "ameli", "health", "ameli"),
    ("northwind.pdf", "rien", "education", "northwind"), ("northwind.pdf", "relevé de compte", "bank", "releve_bancaire"), ("northwind.pdf", "finances publiques", "administrative", "impot"), ("northwind.pdf", "taxe fonciere", "education", "northwind"), ("northwind.pdf", "taxe fonciere, somme a payer", "administrative", "impot"), ("northwind.pdf", "net a payer", "administrative", "general"),
    ("x.pdf", "navigo", "administrative", "navigo"), ("x.pdf", "quittance de loyer", "housing", "justificatif_domicile"), ("x.pdf", "visa de long séjour", "identity", "titre_sejour"), ("x.pdf", "cover letter", "recruitment", "general"), ("x.pdf", "rien", "administrative", "general"),
    ("Dupuis_2024.pdf", "dupuis et dupuis", "administrative", "dupuis"), ("Dupuis.pdf", "dupuis", "administrative", "general"), ("avis lettre.pdf", "lettre lettre", "correspondence", "general"), ("x.pdf", "page de confirmation", "administrative", "attestation_confirmation"), ("x.pdf", "docusign", "education", "cpf"), ("x.pdf", "free mobile", "administrative", "free"), ("fiche_de_paie.pdf", "", "bulletin_salaire", "bulletin_salaire"),
]


@pytest.fixture(scope="module")
def decisions(spark):
    docs = spark.createDataFrame([(i, n, t) for i, (n, t, *_) in enumerate(DECIDED)], "id long, original_filename string, raw_text string")
    return {r["id"]: r for r in decided(docs, "2026-02-01").collect()}


def test_decision_list(decisions):
    wrong = {DECIDED[i][:2]: (r["category"], r["subcategory"]) for i, r in decisions.items() if (r["category"], r["subcategory"]) != DECIDED[i][2:]}
    assert len(decisions) == len(DECIDED) and not wrong
    assert decisions[0]["invoice_type"] == "CLIENT"


def test_decision_sql_on_the_cases(decisions):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE r(id BIGINT, fn VARCHAR, tx VARCHAR, c VARCHAR, n VARCHAR)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?, ?, ?)", [(i, n, t, f"{n} {t}".lower(), n.lower()) for i, (n, t, *_) in enumerate(DECIDED)])
    ruled = W._RULED[W._RULED.index("f AS (") :].replace("FROM h)", "FROM r)")
    found = con.execute(f"WITH {ruled}, {W._CLASSIFIED}").fetchall()
    assert sorted(found) == sorted(tuple(r) for r in decisions.values())
    assert decisions[[d[0] for d in DECIDED].index("Dupuis_2024.pdf")]["title"] == "Dupuis 2024"


GROUNDED = [("page", "page page", "x.pdf", False), ("ab", "ab ab", "x", False), ("dupont", "dupont", "x.pdf", True), ("dupont", "dupont", "Dupont.pdf", False), ("france_travail", "chez France-Travail.", "x", True), ("caf_paris", "la CAF de Paris", "x", True), ("vente_vehicule", "scan", "vehicule-Belleville-vente.pdf", True), ("edf", "bedford", "x", False), ("", "a", "b", False), (None, None, None, False), ("martin_cie", "martin cie", "x", False)]


def test_grounded(spark):
    rows = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(GROUNDED)], "id int, s string, t string, f string").repartition(2)
    got = {r["id"]: r["g"] for r in rows.select("id", G.grounded(F.col("s"), F.col("t"), F.col("f"), ("Martin",)).alias("g")).collect()}
    assert got == {i: r[3] for i, r in enumerate(GROUNDED)}


def test_gate_takes_each_row_alone(spark):
    docs = spark.createDataFrame([(1, "a b", "| a |"), (1, None, None), (None, "x", "x")], "id long, raw string, markdown string")
    rows = Q.gate(docs)
    assert rows.count() == 3 and Q.gate(docs.limit(0)).count() == 0
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_gate_sees_lost_content(spark):
    words = [chr(97 + i // 26) * 3 + chr(97 + i % 26) * 4 for i in range(100)]
    rows = [(i, " ".join(words), " ".join(words[:n])) for i, n in enumerate([100, 55, 54, 0])] + [(4, " ".join(words[:39]), "")]
    got = {r["id"]: r["failures"] for r in Q.gate(spark.createDataFrame(rows, "id long, raw string, markdown string")).collect()}
    assert got == {0: "", 1: "", 2: "content-loss", 3: "content-loss", 4: ""}


def test_every_row_is_upserted(spark):
    docs = spark.createDataFrame([(i, f"p{i}", "bank" if i == 5 else "x") for i in range(24)], "id long, original_path string, category string")
    assert {r["original_path"]: r["size"] for r in W.blocked_upsert_prune(docs).collect()} == {f"p{i}": i for i in range(24) if i != 5}
