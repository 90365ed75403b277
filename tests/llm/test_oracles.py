"""The registered queries that SQL can express, against their oracles; and the stored ledger that several users read."""

import duckdb
import pytest

from matforge.llm import ledger
from matforge.llm import queries as llm


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for name in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tiny}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_queries_agree_with_their_oracles(spark, tiny, duck, name):
    df = llm.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    found = duck.execute(llm.oracle_sql()[name])
    order = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_one_ledger_serves_all_its_users(spark, tiny, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    book = ledger.write_ledger(docs, str(tmp_path / "ledger"))
    alone = {p: sorted(r["doc_id"] for r in ledger.keep_passing(docs, ledger.POLICIES[p]).collect()) for p in ("v1", "lenient")}
    # nothing is measured again
    monkeypatch.setattr(ledger, "ledger", lambda *a: pytest.fail("measured again"))
    for policy, want in alone.items():
        kept = ledger.keep_passing(docs, ledger.POLICIES[policy], book=ledger.read_ledger(spark, str(tmp_path / "ledger")))
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want
    assert len(alone["v1"]) <= len(alone["lenient"]) < docs.count()
    assert {r["kept_without"] >= len(alone["v1"]) for r in ledger.ablation(book).collect()} == {True}
    monkeypatch.setattr(ledger, "RULES_VERSION", "rules-2")
    with pytest.raises(ValueError):
        ledger.read_ledger(spark, str(tmp_path / "ledger"))


def test_rows_of_one_id_are_told_apart(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good), (1, "short"), (None, good), (None, "short"), (2, "short"), (3, good), (3, good), (4, None)]
    kept = ledger.keep_passing(spark.createDataFrame([(i, t, "k", 1, True) for i, t in rows], "doc_id long, text string, key string, n long, stays boolean"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, good), (1, good), (3, good), (3, good)]
