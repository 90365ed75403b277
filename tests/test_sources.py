"""Files in and out, labelled pairs, audit chains, the published index."""

import hmac
import io
import zipfile
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.errors import PySparkException

from matforge.functions.dialect import DUCK, SPARK
from matforge.operators import audit, match, vectors
from matforge.plans import files
from matforge.plans import views as V
from matforge.sources import documents, grids, items, pairs, state
from matforge.streaming import published


def put(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def read(spark, path):
    return [r.asDict() for r in items.items(grids.read_grids(spark, path)).orderBy("ord").collect()]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("MATNR,MAKTX,MEINS\nM-001,HEX NUT M12 SS304,NOS\nM-002,HEX BOLT M12 X 50,EA\n", ("M-001", "HEX NUT M12 SS304", "NOS", None)),
        ("Material Code;Material Description;Unit\nM-001;HEX NUT M12, SS304;NOS\nM-002;BOLT;EA\n", ("M-001", "HEX NUT M12, SS304", "NOS", None)),
        ("M-001\tHEX NUT M12 SS304 DIN934\tNOS\nM-002\tHEX BOLT M12 X 50 SS304\tEA\n", ("M-001", "HEX NUT M12 SS304 DIN934", "NOS", None)),
        ('\ufeffCode,Description,Qty,Unit Price,UOM\r\nM-001,"HEX ""NUT"" M12","1,25,000",₹ 10,NOS\r\n', ("M-001", 'HEX "NUT" M12', "NOS", 125000.0)),
    ],
)
def test_layouts(spark, tmp_path, text, expected):
    first = read(spark, put(tmp_path, list__csv=text))[0]
    assert (first["own_code"], first["raw_description"], first["uom"], first["quantity"]) == expected
    assert first["cpse_id"] == "ONGC" and first["row_number"] == 1


def test_mixed_organisations_missing_codes_and_skipped_rows(spark, tmp_path):
    path = put(
        tmp_path,
        a__csv="Organization,Description,UOM\nsail,HEX NUT M12 SS304 DIN934,NOS\n,GATE VALVE 4 INCH CLASS 300,EA\nBHEL,  ,EA\n",
        b__txt="Description,Code\nHEX NUT M12 SS304 DIN934,\n",
    )
    rows = read(spark, path)
    assert [(r["cpse_id"], r["own_code"], r["row_number"]) for r in rows] == [("SAIL", "ROW-1", 1), ("ONGC", "ROW-2", 2), ("IOCL", "", 1)]
    lost = {r["file"][-5:]: r["skipped"] for r in items.skipped(grids.read_grids(spark, path)).collect()}
    assert lost == {"a.csv": 1, "b.txt": 0}


def workbook(rows):
    shared = sorted({c for r in rows for c in r if isinstance(c, str)})
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="s"><v>{shared.index(v)}</v></c>' if isinstance(v, str) else "" if v is None else f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>'
    sheet = "".join(f'<row r="{k}">' + "".join(cell(k, c, v) for c, v in enumerate(r)) + "</row>" for k, r in enumerate(rows, 1))
    out, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/one.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    rows = read(spark, put(tmp_path, w__xlsx=workbook([["Code", "Description", "UOM", "Qty"], ["M-1", "HEX NUT M12 SS304", None, 5], ["M-2", "HEX BOLT M12 X 50", "EA", 7]])))
    assert [(r["own_code"], r["uom"], r["quantity"]) for r in rows] == [("M-1", "", 5.0), ("M-2", "EA", 7.0)]


@pytest.mark.parametrize("name,content", [("a.pdf", b"x"), ("a.xls", b"x"), ("a.csv", b"x" * (grids.MAX_BYTES + 1))])
def test_refused_uploads(spark, tmp_path, name, content):
    (tmp_path / name).write_bytes(content)
    with pytest.raises(grids.ParseError):
        grids.read_grids(spark, str(tmp_path))


def test_unreadable_and_unfit_files(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    with pytest.raises(PySparkException, match="could not be read"):
        grids.read_grids(spark, put(tmp_path / "bad", a__xlsx=b"no workbook")).collect()
    (tmp_path / "short").mkdir()
    with pytest.raises(grids.ParseError):
        items.items(grids.read_grids(spark, put(tmp_path / "short", a__csv="Code,Qty\nA-100,5\nA-101,6\n")))


def test_documents_round_trip_bytes(spark, tmp_path):
    texts = ["=1+1", "-5", 'say "x"', "a,b", "two\nlines", "plain", None]
    rows = spark.createDataFrame([(k, t, -float(k)) for k, t in enumerate(texts)], "place long, t string, n double")
    cells = documents.line([documents.text_cell(SPARK, "t"), documents.number_cell(SPARK, "n")])
    made = documents.write_documents(rows.selectExpr("'x.csv' AS document", "'T,N' AS header", "place", f"{cells} AS line"), str(tmp_path / "out"))
    raw = (tmp_path / "out" / "x.csv").read_bytes()
    assert raw.decode() == '\ufeffT,N\r\n\'=1+1,-0\r\n\'-5,-1\r\n"say ""x""",-2\r\n"a,b",-3\r\n"two\nlines",-4\r\nplain,-5\r\n,-6\r\n'
    assert [tuple(r) for r in made.collect()] == [("x.csv", 7, len(raw))]
    assert documents.write_documents(rows.filter("place < 0").selectExpr("'x' AS document", "'' AS header", "place", "t AS line"), str(tmp_path / "none")).count() == 0


def grid(spark, rows):
    return spark.createDataFrame([("f", k, r) for k, r in enumerate(rows)], "file string, row_idx long, cells array<string>")


def test_labelled_pairs(spark):
    rows = pairs.labelled_rows(grid(spark, [["Ground Truth", "Material A", "Material B"], ["duplicate", "x", "y"], ["", "", ""], ["Functionally-Equivalent", "x", "y"], ["distinct", "x", ""], ["perhaps", "x", "y"]]))
    assert [(r["pair_id"], r["truth"]) for r in pairs.pairs(rows).orderBy("pair_id").collect()] == [("P1", "DUPLICATE"), ("P2", "FUNCTIONALLY_EQUIVALENT")]
    assert [(r["line"], r["error"][:12]) for r in pairs.errors(rows).orderBy("line").collect()] == [(4, "both materia"), (5, "unknown grou")]
    plain = pairs.labelled_rows(grid(spark, [["x", "y", "similar"]])).first()
    assert (plain["left_text"], plain["right_text"], plain["truth"], plain["error"]) == ("x", "y", "SIMILAR", None)
    broken = pairs.labelled_rows(grid(spark, [["Material A", "Label"], ["x", "similar"]])).collect()
    assert len(broken) == 1 and broken[0]["error"].startswith("Header must")


def test_audit_chains(spark):
    entries = spark.createDataFrame([(k, f"t{k}", "issue", None if k == 3 else f"d{k}" if k % 2 else f'{{"b": 1.0, "a": [{k}, "x"], "c": null}}') for k in range(600)], "seq long, timestamp string, action string, details string")
    log = audit.append(entries)
    kept = audit.anchors(log)
    assert log.count() == 600 and audit.verify(log, kept).isEmpty()
    assert len({r["hash"] for r in log.collect()}) == 600 and len(audit.digest(log).first()["digest"]) == 12
    faults = lambda changed, anchors=kept, head=None: sorted((r["seq"], r["problem"]) for r in audit.verify(changed, anchors, head).collect())
    assert faults(log.withColumn("details", audit.F.expr("IF(seq = 5, 'other', details)"))) == [(5, "hash")]
    assert faults(log.withColumn("details", audit.F.expr("IF(seq = 4, '{\"c\":null, \"a\":[4,\"x\"],\"b\":1}', details)"))) == [], "the order of keys does not matter"
    assert faults(log.filter("seq <> 0")) == [(1, "link")] and faults(log.filter("seq <> 255")) == [(255, "anchor")]
    first, second = (r["anchor"] for r in kept.orderBy("segment").collect())
    assert second == audit.link_anchor(first, 1, log.filter("seq = 511").first()["hash"])
    assert faults(log, kept.withColumn("anchor", audit.F.expr("IF(segment = 0, reverse(anchor), anchor)"))) == [(255, "anchor"), (511, "anchor")]
    last = {"entries": 600, "last": log.filter("seq = 599").first()["hash"], "anchor": second}
    assert faults(log, kept, last) == [] and faults(log.filter("seq <> 599"), kept, last) == [(599, "head")]
    assert audit.digest(log.filter("seq < 0")).first()["digest"] == "GENESIS" and audit.append(entries.filter("seq < 0")).isEmpty()
    whole = {r["seq"]: r["hash"] for r in log.collect()}
    for cut in (256, 300):
        ahead = audit.append(entries.filter(f"seq >= {cut}"), cut, whole[cut - 1])
        assert all(whole[r["seq"]] == r["hash"] for r in ahead.collect()), "a batch goes on inside an open segment"


def _signed(text, key):
    return hmac.new(key.encode(), text.encode(), "sha256").hexdigest()


def test_only_codes_are_compared_by_entry(spark):
    log = spark.createDataFrame([(1, '{"nmcCode": "A-1", "verdict": "similar", "reasons": ["A-1", "B-2", "B-2"]}'), (1, '{"nmcCode": "B-2"}'), (2, '{"nmcCode": "B-2", "linkedNmcCode": null}'), (3, '{"ownCode": "C-9"}')], "entry long, details string")
    codes = spark.createDataFrame([("A-1",), ("B-2",), ("D-4",)], "nmc_code string")
    found = spark.sql(audit.references(V.named(log), V.named(codes)))
    assert sorted(map(tuple, found.collect())) == [("A-1", 1), ("B-2", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[plan.index("Join ") : plan.index("Generate ")]


def test_forged_signatures_are_found(spark):
    """A stand-in scheme, in which the public key is the secret, for the pluggable verifier."""
    log = audit.append(spark.createDataFrame([(k, "t", "review", '{"n":1}') for k in range(6)], "seq long, timestamp string, action string, details string"))
    texts = {r["seq"]: r["p"] for r in log.selectExpr("seq", audit.payload("seq", audit.told("timestamp", "action"), audit.canonical("details"), "prev_hash") + " AS p").collect()}
    signers = {0: [("R1", "k1", _signed(texts[0], "k1"))], 1: [("R1", "k1", _signed(texts[1], "k1")), ("R2", "k2", "forged")], 2: None, 3: [("R3", "k3", "")], 4: [("R1", "k1", "wrong")]}
    rows = spark.createDataFrame(list(signers.items()), f"seq long, signers {audit.SIGNERS}")
    signed = log.join(rows, "seq", "left")
    check = lambda pubs, texts, sigs: [_signed(t, p) == s for p, t, s in zip(pubs, texts, sigs)]
    status = {(r["seq"], r["id"]): r["sig_status"] for r in audit.signatures(signed, check).collect()}
    assert status == {(0, "R1"): "valid", (1, "R1"): "valid", (1, "R2"): "forged", (3, "R3"): "unsigned", (4, "R1"): "forged"}
    assert {r["sig_status"] for r in audit.signatures(signed).collect()} == {"unverified", "unsigned"}
    problems = audit.verify(signed, audit.anchors(log), verifier=check)
    assert sorted(map(tuple, problems.collect())) == [(1, "signature"), (4, "signature")] and audit.first_failure(problems).first()["seq"] == 1
    changed = signed.withColumn("details", audit.F.expr("IF(seq = 1, '{}', details)"))
    assert dict(map(tuple, audit.verify(changed, audit.anchors(log), verifier=check).collect())) == {1: "hash", 4: "signature"}, "a changed entry counts before its signatures"


def test_fifty_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    log = audit.AuditLog(spark, f"{tmp_path}/log")
    schema = "place long, timestamp string, action string, details string"
    with ThreadPoolExecutor(50) as pool:
        list(pool.map(lambda k: log.append(spark.createDataFrame([(i, "t", f"w{k}", f'{{"i":{i}}}') for i in range(3)], schema), ["place"]), range(50)))
    rows = log.entries().orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(150)) and {r["action"] for r in rows} == {f"w{k}" for k in range(50)}
    assert all(rows[i]["action"] == rows[i + 1]["action"] == rows[i + 2]["action"] for i in range(0, 150, 3)), "a batch stays together"
    assert log.verify().isEmpty() and log.head()["commits"] < 50
    # another process took the next commit: the batch is hashed again behind it
    other, real, taken = audit.AuditLog(spark, f"{tmp_path}/log"), log.head, []

    def late():
        now = real()
        if not taken:
            taken.append(1)
            other._write(audit.placed(spark.createDataFrame([("t", "other", "{}", None)], f"timestamp string, action string, details string, signers {audit.SIGNERS}"), ["action"]))
        return now

    monkeypatch.setattr(log, "head", late)
    log.append(spark.createDataFrame([(i, "t", "mine", "{}") for i in range(200)], schema), ["place"])
    monkeypatch.setattr(log, "head", real)
    actions = [r["action"] for r in log.entries().orderBy("seq").collect()]
    assert actions[150:] == ["other"] + ["mine"] * 200 and log.verify().isEmpty() and log.anchors().count() == 1
    assert log.head()["commits"] == len(state.names(spark, f"{tmp_path}/log/commits"))


def test_published_index_from_a_stream(spark, tmp_path):
    source, index = tmp_path / "in", str(tmp_path / "index")
    schema = "nmc_code string, cpse_id string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").json(str(source))
        published.publish_stream(spark.readStream.schema(schema).json(str(source)), index, str(tmp_path / "check")).awaitTermination(120)

    arrive([("NMC-PIP-1", "ONGC"), ("NMC-PIP-1", "ONGC"), ("NMC-PIP-1/2.5", "SAIL"), ("bad code", "SAIL"), ("NMC-X", None)])
    arrive([("NMC-PIP-1", "SAIL"), ("NMC-PIP-1", "ONGC")])
    known = published.index(spark, index)
    assert sorted((r["nmc_code"], r["cpse_id"]) for r in known.collect()) == [("NMC-PIP-1", "ONGC"), ("NMC-PIP-1", "SAIL"), ("NMC-PIP-1/2.5", "SAIL")]
    asked = spark.createDataFrame([("NMC-PIP-1", "ONGC"), ("NMC-PIP-1/2.5", "SAIL")], schema)
    assert {r["nmc_code"]: r["others"] for r in published.lookup(asked, known).collect()} == {"NMC-PIP-1": "SAIL", "NMC-PIP-1/2.5": ""}
    refused = published.requests(spark.createDataFrame([("NMC-A", "x" * 41), ("-A", "SAIL"), ("N" * 151, "SAIL"), ("NMC-A+1", "COAL INDIA")], schema))
    assert [r["refused"] for r in refused.collect()] == ["organisation", "code", "code", None]


def test_state_tables(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    assert state.read_or_empty(spark, path, "x long").isEmpty()
    for n in (3, 2, 4):
        state.replace(spark.range(n).selectExpr("id AS x"), path)
        assert state.read_or_empty(spark, path, "x long").count() == n
    assert len(state.names(spark, path)) == 3, "the pointer, the table and the one before"
    # a writer that fails before, or between, its steps leaves the old table
    with pytest.raises(Exception):
        state.replace(spark.range(9).selectExpr("raise_error('no') AS x"), path)
    monkeypatch.setattr(state, "write_text", lambda *a, **k: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        state.replace(spark.range(9).selectExpr("id AS x"), path)
    monkeypatch.undo()
    assert state.read_or_empty(spark, path, "x long").count() == 4
    assert state.write_text(spark, f"{path}/once", "a", overwrite=False) and not state.write_text(spark, f"{path}/once", "b", overwrite=False)
    assert state.read_text(spark, f"{path}/once") == "a"
    (version,) = (tmp_path / "table" / (tmp_path / "table" / "CURRENT").read_text()).glob("part-*"), 
    for part in version:
        part.write_bytes(b"damaged")
    assert state.read_or_empty(spark, path, "x long").isEmpty(), "what cannot be read counts as empty"
    state.remove(spark, path)
    assert state.read_or_empty(spark, path, "x long").isEmpty()



def test_vectors_are_computed_once_and_failures_again(spark, tmp_path):
    cache, seen = str(tmp_path / "cache"), tmp_path / "seen"
    seen.mkdir()

    def embed(texts):
        for t in texts:
            (seen / f"{t}.{len(list(seen.iterdir()))}").touch()
        return [None if t == "bad" else [1.0, 0.0] for t in texts]

    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "t string")
    first = vectors.embed_counted(texts("a", " A ", "b", "bad", None), embed, cache)
    assert {r["text"]: r["vector"] for r in first.vectors.collect()} == {"a": [1.0, 0.0], " A ": [1.0, 0.0], "b": [1.0, 0.0], "bad": None}
    assert (first.hits, first.computed, first.failed) == (0, 2, 1)
    again = vectors.embed_counted(texts("a", "A\t", "c", "bad"), embed, cache)
    assert {r["text"] for r in again.vectors.collect()} == {"a", "A\t", "c", "bad"} and (again.hits, again.computed, again.failed) == (2, 1, 1)
    assert sorted(p.name.split(".")[0].strip().lower() for p in seen.iterdir()) == ["a", "b", "bad", "bad", "c"]
    # the oldest make room; a call's own texts are answered all the same
    third = vectors.embed_counted(texts("d", "e", "f"), embed, cache, most=4)
    assert all(r["vector"] for r in third.vectors.collect())
    kept = {r["key"] for r in state.read_or_empty(spark, cache, vectors.SCHEMA).collect()}
    assert kept == {"d", "e", "f", "c"} and vectors.embed_counted(texts("d", "c"), embed, cache).computed == 0
    assert vectors.embed_counted(texts(None), embed, cache).vectors.count() == 0


def test_vectors_enter_the_cascade(spark, tmp_path):
    """Texts that a model calls alike match although they share no word; failed texts fall back on their words."""
    names = ["MYSTERY WIDGET KIT", "UNKNOWN GADGET SET", "THIRD THING", "BROKEN WORDING HERE", "BROKEN WORDING HERE TOO", "HEX NUT M12 SS304"]
    near = {"MYSTERY WIDGET KIT": [1.0, 0.0], "UNKNOWN GADGET SET": [0.95, (1 - 0.95**2) ** 0.5], "THIRD THING": [0.0, 1.0]}
    rows = V.code_materials(spark.createDataFrame([(k, "ONGC", f"C{k}", "EA", 1.0, 1.0, t) for k, t in enumerate(names)], "ord long, cpse_id string, own_code string, uom string, quantity double, unit_price double, raw_description string"))
    made = vectors.embed_counted(match.planned_texts(rows), lambda texts: [near.get(t) for t in texts], str(tmp_path / "cache"))
    assert (made.computed, made.failed) == (3, 2), "the nut stands alone in its block and needs no vector"
    got = {r["ord"]: r for r in match.map_materials(rows, vectors=made.vectors).collect()}
    assert (got[1]["verdict"], got[1]["stage"], round(got[1]["confidence"], 6), got[1]["matched_ord"]) == ("duplicate", "embedding", 0.95, 0)
    assert (got[2]["verdict"], got[4]["stage"], got[4]["matched_ord"]) == ("distinct", "lexical", 3)


@pytest.mark.parametrize("chunk", [3, 1024])
def test_all_near_vectors_are_found(spark, monkeypatch, chunk):
    monkeypatch.setattr(match, "CHUNK", chunk)
    rng = vectors.np.random.default_rng(1)
    rows = []
    for k in range(60):
        v = rng.normal(0, 1, 3)
        rows.append((k, f"B{k % 2}", k % 5 == 0, k, k + 30, k % 17 == 0, None if k % 13 == 0 else (v / vectors.np.linalg.norm(v)).tolist()))
    pool = spark.createDataFrame(rows, "tid long, block string, complete boolean, first_ord long, last_ord long, echo boolean, vector array<double>")
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[6] and b[6] and not a[5] and not b[5] and not (a[2] and b[2]) and b[3] < a[4] and sum(x * y for x, y in zip(a[6], b[6])) > 0.6}
    found = [(r["x"], r["y"]) for r in match.near_vectors(pool).collect()]
    assert set(found) == want and len(found) == len(set(found)) and len(want) > 50


def test_reclassification_against_brute_force(spark, tiny):
    rows = files.zero_shot_reclassify(spark, tiny).collect()
    phrases = vectors.prototypes()
    wanted = [vectors.trigram_vectors([p])[0] for _, p in phrases]
    for r in rows:
        own = vectors.trigram_vectors([r["raw_description"]])[0]
        scores = [round(sum(a * b for a, b in zip(map(float, vectors.np.float32(own)), w, strict=True)), 9) for w in wanted]
        best = max(range(len(scores)), key=lambda k: (scores[k], -k))
        assert r["subtype"] == (phrases[best][0] if scores[best] > vectors.LEAST else "UNK")
        assert r["classified_by"] == ("ai" if scores[best] > vectors.LEAST else "rules")
    assert len({r["ord"] for r in rows}) == len(rows) > 0


NUMBERS = [1e7, 12345678.9, 0.00012, 1e12, 987654321012.5, 5.0, -2.5, 0.1, 0.0, 1e15, 100.0, None]


def test_large_numbers_are_written_out_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(k, "ONGC", f"C-{k}", f"HEX NUT M{k + 4} SS304", "EA", x, 1.5) for k, x in enumerate(NUMBERS)], "place long, cpse string, code string, text string, uom string, q double, p double")
    cell = documents.number_cell(SPARK, "q")
    assert [r["c"] for r in rows.selectExpr(f"{cell} AS c", "place").orderBy("place").collect()] == ["10000000", "12345678.9", "0.00012", "1000000000000", "987654321012.5", "5", "-2.5", "0.1", "0", "1000000000000000", "100", ""]
    duck = [duckdb.sql(f"SELECT {documents.number_cell(DUCK, 'CAST(' + repr(x) + ' AS DOUBLE)')}").fetchall()[0][0] for x in NUMBERS[:-1]]
    assert duck == ["10000000", "12345678.9", "0.00012", "1000000000000", "987654321012.5", "5", "-2.5", "0.1", "0", "1000000000000000", "100"]
    assert spark.sql(f"SELECT {documents.number_cell(SPARK, 'CAST(123456789012 AS BIGINT)')} AS c").first()["c"] == "123456789012"
    cells = documents.line([*(documents.text_cell(SPARK, c) for c in ("cpse", "code", "text", "uom")), cell, documents.number_cell(SPARK, "p")])
    documents.write_documents(rows.selectExpr("'ONGC.csv' AS document", "'CPSE,MATNR,MAKTX,MEINS,Stock Qty,Rate' AS header", "place", f"{cells} AS line"), str(tmp_path))
    read = {r["own_code"]: r["quantity"] for r in items.items(grids.read_grids(spark, str(tmp_path))).collect()}
    assert read == {f"C-{k}": x for k, x in enumerate(NUMBERS)}


def test_a_long_document_is_sorted_by_many_tasks(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 10 = 0 THEN 'b.csv' ELSE 'a.csv' END AS document", "'N' AS header", "(id * 7919) % 20000 AS place", "CAST((id * 7919) % 20000 AS STRING) AS line")
    made = {r["document"]: r for r in documents.write_documents(rows, str(tmp_path / "out")).collect()}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.csv", "b.csv"]
    want = {name: [n for n in range(20_000) if (n % 10 == 0) == (name == "b.csv")] for name in ("a.csv", "b.csv")}
    for name, numbers in want.items():
        raw = (tmp_path / "out" / name).read_bytes()
        assert raw.decode() == "\ufeffN\r\n" + "".join(f"{n}\r\n" for n in numbers)
        assert (made[name]["lines"], made[name]["bytes"]) == (len(numbers), len(raw))
    assert documents.write_documents(rows.limit(0), str(tmp_path / "none")).count() == 0 and not any((tmp_path / "none").iterdir())
    tasks = []
    monitor = documents.materialise
    documents.materialise = lambda df, name: tasks.append((name, df.rdd.getNumPartitions())) or monitor(df, name)
    try:
        documents.write_documents(rows, str(tmp_path / "again"))
    finally:
        documents.materialise = monitor
    assert max(n for name, n in tasks) == 4
