"""Whole runs over folders of item lists."""

import pytest

from matforge.operators import audit
from matforge.plans import run
from matforge.sources import grids, state

HEADER = "CPSE,MATNR,MAKTX,MEINS,Stock Qty,Rate\n"


def lists(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, rows in texts.items():
        (folder / f"{name}.csv").write_text(HEADER + "".join(f"{o},{c},{t},EA,2,1.5\n" for o, c, t in rows))
    return str(folder)


A = [("ONGC", "A1", "HEX NUT M12 SS304 DIN934"), ("ONGC", "A2", "MYSTERY WIDGET COOLING TOWER FAN"), ("ONGC", "A3", ""), ("ONGC", "A4", "BALL BEARING 6205 2RS")]
B = [("SAIL", "B1", "Nut Hexagon M12 Stainless 304 DIN 934"), ("SAIL", "B2", "MYSTERY WIDGET COOLING TOWER FANS"), ("SAIL", "B3", "HEX NUT M12 SS316 DIN934")]


def test_runs_share_log_and_registry(spark, tmp_path):
    folder, home = lists(tmp_path / "in", a=A, b=B), str(tmp_path / "home")
    first = run.run(spark, folder, home, at="t1")
    got = {r["own_code"]: r for r in first.mapping.collect()}
    assert got["B1"]["nmc_code"] == got["A1"]["nmc_code"] == "NMC-FAS-HNT-M12-SS304-DIN934" and got["B1"]["status"] == "auto-issued"
    assert (got["B3"]["verdict"], got["B3"]["status"]) == ("functionally_equivalent", "pending-review") and got["B3"]["current_code"] is None
    f = first.figures
    assert (f["kept"], f["skipped"], f["materials"], f["uncategorised"], f["audit_entries"], f["audit_error"], f["embedder_status"]) == (6, 1, 6, 2, 6, None, "not-needed")
    entries = first.log.entries().orderBy("seq").collect()
    # blocks by first appearance, and files in order within them
    assert [r["details"].split('"ownCode":"')[1][:2] for r in entries] == ["A1", "B1", "B3", "A2", "B2", "A4"]
    state.replace(spark.createDataFrame([("NMC-FAS-HNT-M12-SS304-DIN934", "NMC-NEW"), ("NMC-NEW", "NMC-NEWER")], run.SUPERSESSIONS), f"{home}/supersessions")
    second = run.run(spark, folder, home, at="t2")
    assert {r["own_code"]: r["current_code"] for r in second.mapping.collect()}["B1"] == "NMC-NEWER"
    assert {r["nmc_code"]: r["superseded_by"] for r in second.records.collect()}["NMC-FAS-HNT-M12-SS304-DIN934"] == "NMC-NEW"
    log = second.log.entries()
    assert log.count() == 12 and second.log.verify().isEmpty() and audit.digest(log).first()["digest"] != audit.digest(log.filter("seq < 6")).first()["digest"]


def test_a_model_is_asked_once_and_a_failing_log_is_told(spark, tmp_path, monkeypatch):
    folder, home = lists(tmp_path / "in", a=A, b=B), str(tmp_path / "home")
    asked = tmp_path / "asked"
    asked.mkdir()

    def embed(texts):
        for t in texts:
            (asked / f"{abs(hash(t))}-{len(list(asked.iterdir()))}").touch()
        return [[1.0, 0.0] if "WIDGET" in t or "bearing" in t.lower() else [0.0, 1.0] for t in texts]

    first = run.run(spark, folder, home, embed=embed, at="t")
    assert first.figures["reclassified"] == 2 and first.figures["uncategorised"] == 0 and first.figures["embedder_status"] == "ready"
    assert {r["subtype"] for r in first.mapping.filter("raw_description LIKE 'MYSTERY%'").collect()} == {"BRG"}
    assert {r["stage"] for r in first.mapping.filter("own_code = 'B2'").collect()} == {"embedding"}
    before = len(list(asked.iterdir()))
    monkeypatch.setattr(audit.AuditLog, "append", lambda self, rows, order: (_ for _ in ()).throw(OSError("disk full")))
    second = run.run(spark, folder, home, embed=embed, at="t")
    assert second.figures["audit_error"] == "OSError: disk full" and second.figures["audit_entries"] == 0 and second.mapping.count() == 6
    assert second.figures["embeddings_computed"] == 0 and second.figures["cache_hits"] > 0
    phrases = len(list(asked.iterdir())) - before  # the phrases themselves are a fixed few and not cached
    assert phrases == 16


def test_a_folder_without_rows(spark, tmp_path):
    with pytest.raises(grids.ParseError):
        run.run(spark, lists(tmp_path / "in", a=[("ONGC", "A1", "")]), str(tmp_path / "home"))
