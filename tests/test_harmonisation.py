"""Golden expectations of the harmonisation operators."""

import random

import duckdb
import pytest

from matforge.functions import text as T
from matforge.functions.dialect import DUCK, SPARK
from matforge.operators.extract import ATTRIBUTES
from matforge.operators import economics, match, review, supersession
from matforge.operators.pointers import cycle_names, roots
from matforge.plans import derived, oracles
from matforge.plans import queries as Q
from matforge.plans import views as V

#: Description, subtype, corrosion class (or None), some attributes.
GOLDEN = [
    ("HEX NUT M12 SS304 DIN 934", "HNT", "HIGH", {"thread": "M12", "grade": "SS304", "standard": "DIN934"}),
    ("Nut, Hexagon, M12, Stainless Steel 304, DIN934 STD", "HNT", "HIGH", {"thread": "M12", "grade": "SS304"}),
    ("HEX NUT M12 MS ZINC PLATED DIN934", "HNT", "MEDIUM", {"grade": "MS", "finish": "ZN"}),
    ("HEX BOLT M12 X 50 SS304", "BLT", "HIGH", {"thread": "M12", "length": "50MM"}),
    ("FLANGE WELD NECK 150MM CLASS 150 RF ASTM A105", "FLG", "LOW", {"size": "DN150", "pressure": "CL150", "flgType": "WN", "face": "RF", "grade": "A105"}),
    ("GATE VALVE 4 INCH CLASS 300 FLANGED WCB", "VLV", "LOW", {"valveType": "GATE", "size": "DN100", "pressure": "CL300", "endConn": "FLANGED"}),
    ("SEAMLESS PIPE 6 INCH SCH 40 A106 GR B", "PPE", "LOW", {"size": "DN150", "schedule": "SCH40", "pipeType": "SMLS", "grade": "A106B"}),
    ("INDUCTION MOTOR 5 HP 415V 3 PHASE 4 POLE", "MTR", None, {"power": "3.7KW", "voltage": "415V", "phase": "3PH", "poles": "4P"}),
    ("XLPE POWER CABLE 3.5C X 95 SQMM COPPER", "CBL", "MEDIUM", {"cores": "3.5C", "csa": "95SQMM", "conductor": "CU", "insulation": "XLPE"}),
    ("BALL BEARING 6205 2RS", "BRG", None, {"bearingNo": "6205", "seal": "2RS"}),
    ("MS PLATE 10MM THICK IS 2062", "PLT", "LOW", {"thickness": "10MM", "standard": "IS2062"}),
    ("ISMB 200 X 100 STRUCTURAL BEAM IS 2062", "STR", None, {"section": "ISMB200X100", "standard": "IS2062"}),
    ("PRESSURE GAUGE 0-100 BAR 100MM DIAL", "GAG", None, {"range": "0-100BAR", "dial": "DIAL100"}),
    ("HYDRAULIC OIL ISO VG 46", "LUB", None, {"lubType": "HYD", "viscosity": "VG46"}),
    ("MISCELLANEOUS OFFICE STATIONERY ITEM XYZ", "UNK", None, {}),
    ("HEX NUT M100 SS304", "HNT", "HIGH", {"thread": "M100"}),
    ("HEX BOLT M12X150 SS304 DIN933", "BLT", "HIGH", {"thread": "M12", "length": "150MM"}),
    ("HEX BOLT M8X1.25X40 SS304", "BLT", "HIGH", {"thread": "M8", "length": "40MM"}),
    ("ELBOW 3/8 INCH", "FIT", None, {"size": "DN80"}),
    ("NYLOCK NUT M12 SS304", "UNK", "HIGH", {}),
]
CODES = {"HEX NUT M12 SS304 DIN934": "NMC-FAS-HNT-M12-SS304-DIN934", "HEX NUT SPECIAL SIZE SS304": "NMC-FAS-HNT-SS304-V5ZNV8FJ", "MISCELLANEOUS OFFICE STATIONERY STAPLER": "NMC-UNC-UNK-ST7WRN95"}
HASHES = {"hello world": "MWBS482G", "goodbye world": "EHFVSNGV", "": "RPBMFCMC"}
NUMBERS = {"1,234.50": 1234.5, "1,25,000": 125000, "₹ 1,250.50": 1250.5, "Rs. 1200": 1200, "INR 99": 99, "$3.5": 3.5, "(1,200)": -1200, "-7": -7, "": None, "abc": None, "12abc": None, "1,2": None, "1.2.3": None, "N/A": None, "12 NOS": None}


def materials(spark, texts, **extra):
    rows = [(k, "ORG" + str(k % 3), f"C-{k}", "NOS", 1.0, 2.0, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "ord long, cpse_id string, own_code string, uom string, quantity double, unit_price double, raw_description string")


def test_attributes_and_codes(spark):
    texts = [g[0] for g in GOLDEN] + list(CODES) + [None, ""]
    got = {r["raw_description"]: r for r in V.code_materials(materials(spark, [t for t in texts if t is not None])).collect()}
    for text, subtype, corrosion, attrs in GOLDEN:
        assert got[text]["subtype"] == subtype, text
        assert got[text]["corrosion"] == corrosion, text
        assert {k: got[text][f"a_{k}"] for k in attrs} == attrs
    assert {t: got[t]["nmc_code"] for t in CODES} == CODES
    assert got[""]["subtype"] == "UNK" and len(ATTRIBUTES) == 33


@pytest.mark.parametrize("texts,expression", [(HASHES, T.short_hash), (NUMBERS, T.parse_number)])
def test_scalars_on_both_engines(spark, texts, expression):
    duck = {t: duckdb.sql(f"SELECT {expression(DUCK, T.quoted(t))}").fetchall()[0][0] for t in texts}
    ours = {r["x"]: r["y"] for r in spark.createDataFrame([(t,) for t in texts], "x string").selectExpr("x", f"{expression(SPARK, 'x')} AS y").collect()}
    assert duck == texts and ours == texts


def test_units(spark):
    got = spark.createDataFrame([("NOS",), ("ea",), ("Pcs",), ("MTR",), ("m",), ("DRUM",)], "x string").selectExpr(f"{T.normalize_uom(SPARK, 'x')} AS y").collect()
    assert [r["y"] for r in got] == ["EA", "EA", "EA", "M", "M", "DRUM"]


def test_scenario_matches_the_published_accuracy(spark, small):
    rows = Q.build("scenario_decisions")(spark, small).collect()
    equivalent = lambda x: x in ("DUPLICATE", "FUNCTIONALLY_EQUIVALENT")
    for label, cells in (("predicted", (8, 1, 1, 15)), ("baseline", (1, 3, 8, 13))):
        found = [(r["truth"], r["predicted"] if label == "predicted" else "DUPLICATE" if r["similarity"] >= 0.8 else "NOT_EQUIVALENT") for r in rows]
        assert tuple(sum((equivalent(t), equivalent(p)) == c for t, p in found) for c in ((True, True), (False, True), (True, False), (False, False))) == cells
    assert sum(r["truth"] == r["predicted"] for r in rows) / 25 == 0.92 and sum(r["needs_review"] for r in rows) == 7
    merged = [r for r in rows if r["predicted"] == "DUPLICATE" and not r["needs_review"]]
    assert len(merged) == 6 and sum(r["truth"] != "DUPLICATE" for r in merged) == 1
    pairs = {r["pair_id"]: r for r in rows}
    assert [pairs[f"P{k}"]["rule_no"] for k in (1, 9, 10, 13, 17, 20)] == [1, 3, 6, 2, 4, 12]
    assert round(pairs["P6"]["similarity"], 4) == 0.7533 and round(pairs["P23"]["similarity"], 4) == 0.804


def test_best_of_all_and_scale(spark):
    got = {r["ord"]: r for r in V.map_materials(V.code_materials(materials(spark, ["HEX NUT M12 SS304 DIN934", "HEX NUT M12 SS304 ISO4032", "Nut Hexagon M12 Stainless 304 ISO 4032"]))).collect()}
    assert (got[1]["verdict"], got[1]["matched_ord"]) == ("similar", 0)
    assert (got[2]["verdict"], got[2]["matched_ord"], got[2]["status"]) == ("duplicate", 1, "auto-issued")
    sizes = [f"HEX BOLT M{10 + k % 60} X {20 + 5 * (k // 60)} SS304" for k in range(300)]
    many = V.map_materials(V.code_materials(materials(spark, sizes * 10)))
    assert many.select("nmc_code").distinct().count() == 300 and many.count() == 3000


def walked(up):
    """Where each node's walk ends, or the first node that it meets again."""
    out = {}
    for node in up:
        seen, at = set(), node
        while up.get(at) is not None and at not in seen:
            seen.add(at)
            at = up[at]
        out[node] = at
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pointers_follow_chains_and_cycles(spark, seed):
    rng = random.Random(seed)
    up = {i: i - 1 if i else None for i in range(20)} | {100: 101, 101: 102, 102: 101, 200: 999} | {300 + i: 300 + rng.choice([i + 1, i + 1, i + 1, rng.randrange(40)]) for i in range(40)}
    frame = spark.createDataFrame(list(up.items()), "n long, up long")
    want = walked(up)
    assert {r["n"]: r["root"] for r in roots(frame, "n", "up").collect()} == want and want[100] == 101
    named = {r["n"]: r["cycle"] for r in cycle_names(frame, "n", "up").collect()}
    looped = {n for n in up if want[n] == n and up[n] is not None}
    assert set(named) == looped and named[101] == named[102] == 101
    assert all(named[n] == named[up[n]] for n in looped) and all(min(k for k in named if named[k] == c) == c for c in named.values())
    assert roots(frame.limit(0), "n", "up").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_a_batch_of_supersessions_is_taken_one_by_one(spark, seed):
    rng = random.Random(seed)
    codes = [f"N{i}" for i in range(12)]
    said = [(i, rng.choice([*codes, "X", " N3 "]), rng.choice([*codes, "X", None, " "]), rng.choice(["worn", "ok", "no longer made"])) for i in range(40)]
    chain = {"N0": "N1", "N5": "N6"}
    taken, want = dict(chain), []
    for place, old, new, reason in said:
        a, b = old.strip(), (new or "").strip()
        end, seen = b, set()
        while end in taken and end not in seen:
            seen.add(end)
            end = taken[end]
        outcome = "code missing" if not a or not b else "itself" if a == b else "reason" if len(reason) < 3 else "unknown code" if a not in codes else "unknown replacement" if b not in codes else f"already superseded by {taken[a]}" if a in taken else "cycle" if end == a else "ok"
        if outcome == "ok":
            taken[a] = b
        want.append((place, outcome.split(" by ")[0]))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    ends = walked({c: chain.get(c) for c in codes})
    got = supersession.accepted(frame(said, "place long, old_code string, new_code string, reason string"), frame([(c,) for c in codes], "nmc_code string"), frame(list(chain.items()), "old_code string, new_code string"), frame(list(ends.items()), "nmc_code string, root string"))
    assert sorted((r["place"], r["outcome"].split(" by ")[0]) for r in got.collect()) == want


def test_only_the_first_sound_decision_counts(spark):
    mapping = spark.createDataFrame([(1, "LOW", "pending-review"), (2, "LOW", "pending-review")], "ord long, safety_risk string, status string")
    said = [(1, "confirmed", "A", 5), (1, "rejected", "B", 4), (1, "rejected", "C", 9), (2, "confirmed", " ", 1), (2, "confirmed", "D", 2)]
    decisions = spark.createDataFrame(said, "ord long, outcome string, reviewer string, audit_seq long").selectExpr("*", "CAST(NULL AS STRING) AS second_reviewer", "'t' AS at")
    got = {r["audit_seq"]: r["refused"] for r in fixed(spark, mapping=mapping, decisions=decisions).sql("SELECT * FROM {checked}").collect()}
    assert got == {5: "not pending", 4: None, 9: "not pending", 1: "reviewer missing", 2: None}


def test_comparisons_are_those_of_a_run_row_by_row(spark):
    nuts = [f"HEX NUT M{k} SS304 DIN934" for k in range(4, 20, 2)]
    mixed = [*nuts, "HEX NUT M12 SS316", "HEX NUT ODD ONE", "HEX NUT M12 SS304 DIN934", "HEX NUT ODD TWO", "HEX NUT M12 BRASS", "HEX NUT ODD ONE"]
    for texts, n in ((nuts, 0), (mixed, 1 + 9 + 1 + 10 + 4 + 12)):
        m = V.named(V.code_materials(materials(spark, texts)))
        assert spark.sql(match.comparisons(m)).first()["comparisons"] == n


def test_repeated_texts_match_the_first_of_them(spark):
    texts = ["MYSTERY WIDGET COOLING TOWER FAN ASSEMBLY SPARE KIT", "OTHER THING ALTOGETHER", "MYSTERY WIDGET COOLING TOWER FAN ASSEMBLY SPARE KIT Q", "MYSTERY WIDGET COOLING TOWER FAN ASSEMBLY SPARE KIT"]
    got = {r["ord"]: r for r in V.map_materials(V.code_materials(materials(spark, texts * 2))).collect()}
    assert [(got[k]["matched_ord"], got[k]["verdict"], got[k]["status"]) for k in range(8)] == [
        (None, "distinct", "auto-issued"), (None, "distinct", "auto-issued"), (0, "duplicate", "pending-review"), (0, "duplicate", "pending-review"),
        (0, "duplicate", "pending-review"), (1, "duplicate", "pending-review"), (2, "duplicate", "pending-review"), (0, "duplicate", "pending-review")]
    assert got[2]["nmc_code"] == got[0]["own_nmc"] != got[2]["own_nmc"] and got[6]["nmc_code"] == got[0]["nmc_code"]


def test_economics_golden(spark):
    rows = [(0, "ONGC", "O-1", "NOS", 100.0, 10.0, "HEX NUT M12 SS304 DIN934"), (1, "SAIL", "S-1", "EA", 50.0, 8.0, "Nut Hexagon M12 Stainless 304 DIN 934"), (2, "BHEL", "B-1", "NOS", 50.0, 9.0, "HEX NUT M12 SS304 DIN934")]
    m = V.named(V.code_materials(spark.createDataFrame(rows, "ord long, cpse_id string, own_code string, uom string, quantity double, unit_price double, raw_description string")))
    per_code = spark.sql(economics.by_code(SPARK, m))
    (r,) = per_code.collect()
    assert (r["total_quantity"], r["uom"], r["value"], r["min_price"], r["max_price"], r["weighted_avg_price"], r["savings"], r["cpses"]) == (200, "EA", 1850, 8, 10, 9.25, 250, "BHEL|ONGC|SAIL")
    (s,) = spark.sql(economics.summary(SPARK, m, V.named(per_code))).collect()
    assert (s["reduction_pct"], s["savings_pct"]) == (66.7, 13.5)


def fixed(spark, **made):
    """Relations with some of them given."""
    relations = derived.Relations(spark, "")
    relations.made = {k: V.named(df) for k, df in made.items()}
    return relations


def test_superseded_codes_pool_under_the_code_in_force(spark):
    rows = [(0, "ONGC", "O", "NOS", 10.0, 5.0, "A", "A", "A"), (1, "SAIL", "S", "EA", 20.0, 4.0, "B", "B", "B")]
    mapping = spark.createDataFrame(rows, "ord long, cpse_id string, own_code string, uom string, quantity double, unit_price double, raw_description string, nmc_code string, own_nmc string")
    ends = spark.createDataFrame([("A", "B"), ("B", "B")], "nmc_code string, root string")
    (r,) = fixed(spark, mapping=mapping, ends=ends).by_code().collect()
    assert (r["nmc_code"], r["legacy_codes"], r["total_quantity"], r["savings"]) == ("B", 2, 30, 10)


def test_reviews(spark):
    rows = [
        (0, "ONGC", "O0", "first", "N0", "N0", "distinct", None, 1.0, None, None, "auto-issued"),
        (1, "SAIL", "S1", "merged", "N0", "N1", "duplicate", "MEDIUM", 0.95, 0, "N0", "pending-review"),
        (2, "BHEL", "B2", "same use", "N2", "N2", "functionally_equivalent", "LOW", 0.75, 0, "N0", "pending-review"),
        (3, "GAIL", "G3", "same use too", "N2", "N2", "similar", "HIGH", 0.6, 0, "N0", "pending-review"),
        (4, "NTPC", "T4", "risky", "N4", "N4", "similar", "HIGH", 0.6, 0, "N0", "pending-review"),
    ]
    mapping = spark.createDataFrame(rows, "ord long, cpse_id string, own_code string, raw_description string, nmc_code string, own_nmc string, verdict string, safety_risk string, confidence double, matched_ord long, matched_nmc string, status string").selectExpr("*", "'why' AS reason")
    said = [(0, "confirmed", "R1", None, 1), (1, "rejected", "R1", None, 2), (2, "confirmed", "R2", None, 3), (3, "confirmed", " R1 ", "R3", 4), (4, "confirmed", "R1", "r1 ", 5)]
    decisions = spark.createDataFrame(said, "ord long, outcome string, reviewer string, second_reviewer string, audit_seq long").selectExpr("*", "'t' AS at")
    ends = spark.createDataFrame([("N0", "N9"), ("N1", "N1"), ("N2", "N2"), ("N4", "N4")], "nmc_code string, root string")
    r = fixed(spark, mapping=mapping, decisions=decisions, ends=ends)
    assert [x["refused"] for x in r.sql("SELECT refused FROM {checked} ORDER BY ord").collect()] == ["not pending", None, None, None, "second reviewer is the first"]
    got = {x["ord"]: x for x in r.sql("SELECT * FROM {reviewed}").collect()}
    assert (got[1]["nmc_code"], got[1]["original_nmc"], got[1]["status"], got[1]["current_code"]) == ("N1", "N0", "reviewed-rejected", None)
    assert (got[0]["current_code"], got[2]["linked_nmc"], got[3]["reviewed_by"], got[4]["status"]) == ("N9", "N0", "R1; R3", "pending-review")
    (link,) = r.sql("SELECT * FROM {links}").collect()
    assert (link["link_id"], link["verdict"], link["cpses"], link["confirmed_by"], link["audit_seq"], link["n_members"]) == ("N0<->N2", "functionally_equivalent", "BHEL; ONGC; GAIL", "R2; R1; R3", 3, 3)
    assert r.sql(review.members("{proof}")).count() == 3


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in Q.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def relations(spark, tiny):
    return derived.Relations(spark, tiny)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_agree_with_their_oracles(spark, tiny, duck, relations, name):
    df = relations.sql(derived.BODIES[name]) if name in derived.BODIES else Q.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    ours = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    relation = duck.sql(Q.oracle_sql()[name])
    order = [relation.columns.index(c) for c in columns]
    assert ours == sorted(map(repr, (tuple(r[i] for i in order) for r in relation.fetchall())))


def test_the_tables_exercise_every_subtype_and_cascade_row(small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{small}/part.parquet'")
    ask = lambda body: {r[0] for r in con.sql(oracles.oracle("mapping").rsplit("SELECT * FROM (", 1)[0] + body).fetchall()}
    assert len(ask("SELECT DISTINCT subtype FROM m")) == 17
    assert ask("SELECT DISTINCT rule_no FROM evaluated UNION SELECT rule_no FROM ruled") == set(range(1, 13))
    assert ask("SELECT DISTINCT safety_risk FROM mapping") == {None, "LOW", "MEDIUM", "HIGH"}
    assert ask("SELECT count(*) FROM mapping WHERE nmc_code <> own_nmc").pop() > 10
    outcomes = {x.split(" by ")[0] for x in ask(f"SELECT DISTINCT outcome FROM ({oracles.BODIES['supersession_validate']})")}
    assert outcomes == {"ok", "code missing", "itself", "reason", "unknown code", "unknown replacement", "already superseded", "cycle"}
    assert {None, "not pending", "reviewer missing", "second reviewer missing"} <= ask("SELECT DISTINCT refused FROM checked")


def test_links_list_signers_in_the_order_in_which_they_signed(spark):
    told = "link_id string, code_a string, code_b string, place long, cpse_id string, own_code string, raw_description string, member_code string, verdict string, safety_risk string, confidence double, reason string, signers array<string>, at string, audit_seq long, leads boolean"
    one = lambda seq, signers: ("A<->B", "A", "B", 2 * seq, "ONGC", "P-1", "x", "A", "similar", "HIGH", 0.6, "r", signers, "t", seq, True)
    proof = V.named(spark.createDataFrame([one(2, ["REV-0", "REV-9"]), one(1, ["REV-9", "REV-5"])], told))
    got = spark.sql(review.links(proof)).collect()
    assert [(r["confirmed_by"], r["cpses"], r["n_evidence"], r["n_members"]) for r in got] == [("REV-9; REV-5; REV-0", "ONGC", 2, 1)]
