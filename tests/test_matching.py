"""The similarity join against all pairs, and the mapping against a run row by row."""

import random

import pytest

from matforge.functions.dialect import SPARK
from matforge.operators import match, pointers
from matforge.operators.decide import decisions
from matforge.plans import derived
from matforge.plans import views as V

RANK = {"duplicate": 0, "functionally_equivalent": 1, "similar": 2}
GRAVE = {None: 0, "LOW": 0, "MEDIUM": 1, "HIGH": 2}


def coded(spark, texts):
    rows = [(k, "ORG" + str(k % 3), f"C-{k}", "NOS", 1.0, 2.0, t) for k, t in enumerate(texts)]
    return V.code_materials(spark.createDataFrame(rows, "ord long, cpse_id string, own_code string, uom string, quantity double, unit_price double, raw_description string"))


def all_decisions(spark, rows):
    """{(a, b): decision} of all pairs of distinct texts of a block."""
    r = V.named(rows)
    texts = V.named(spark.sql(f"SELECT raw_description, any_value(struct(*)) AS row FROM {r} GROUP BY raw_description"))
    pairs = f"(SELECT a.row AS a, b.row AS b FROM {texts} a JOIN {texts} b ON a.row.block = b.row.block)"
    return {(x["a_text"], x["b_text"]): x for x in spark.sql(f"SELECT a.raw_description AS a_text, b.raw_description AS b_text, * EXCEPT (a, b) FROM ({decisions(SPARK, pairs)}) d").collect()}


def row_by_row(rows, decided):
    """What a run gives that takes the materials of each block in turn."""
    out, blocks = {}, {}
    for m in sorted(rows, key=lambda r: r["ord"]):
        blocks.setdefault(m["block"], []).append(m)
    for bucket in blocks.values():
        by_size, closed, open_ = {}, [], []
        for m in bucket:
            pool = [*(by_size.get(m["dim_key"], {}).values() if m["complete"] else closed), *open_]
            best = match_ = None
            n = 0
            for c in pool:
                d = decided[m["raw_description"], c[0]["raw_description"]]
                if d["verdict"] == "distinct":
                    continue
                n += 1
                worth = (RANK[d["verdict"]], -d["confidence"], GRAVE[d["safety_risk"]])
                if best is None or worth < best:
                    best, match_, said = worth, c, d
                if d["verdict"] == "duplicate" and d["confidence"] == 1 and not d["needs_review"]:
                    break
            code = match_[1] if best and best[0] == 0 else m["nmc_code"]
            if m["complete"]:
                if code not in by_size.setdefault(m["dim_key"], {}):
                    by_size[m["dim_key"]][code] = (m, code)
                    closed.append((m, code))
            else:
                open_.append((m, code))
            reason = "No match found in block" if best is None else said["reason"] + (f" | Best of {n} comparable candidates in block" if n > 1 else "")
            out[m["ord"]] = (code, match_ and match_[0]["ord"], match_ and match_[1], said["verdict"] if best else "distinct", said["rule_no"] if best else None, reason)
    return out


def mapped(spark, rows):
    return {r["ord"]: (r["nmc_code"], r["matched_ord"], r["matched_nmc"], r["verdict"], r["rule_no"], r["reason"]) for r in match.map_materials(rows).collect()}


WORDS = "PUMP SEAL KIT ROTARY KILN DRIVE SPARE CASING LINER M12 SS304 50 PLATE ROLLER GUIDE STEEL STEELS LEFT".split()


@pytest.mark.parametrize("hot,long", [(100, 64), (3, 64), (3, 6), (0, 9)])
def test_no_similar_pair_is_missed(spark, monkeypatch, hot, long):
    monkeypatch.setattr(match, "HOT_TEXTS", hot)
    monkeypatch.setattr(match, "LONG_WORDS", long)
    rng = random.Random(hot + long)
    texts = {" ".join(rng.sample(WORDS, rng.randint(1, 9))) for _ in range(150)} | {"HEX NUT " + " ".join(rng.sample(WORDS, rng.randint(1, 6))) for _ in range(60)} | {"WASHER", "WASHER SPARE", "", "of the", "WASHER washer WASHER", " ".join(WORDS * 3)}
    rows = coded(spark, sorted(texts))
    pool = match.pool_texts(rows)
    name = {r["tid"]: (r["raw_description"], r["complete"]) for r in pool.collect()}
    got = {(name[r["x"]][0], name[r["y"]][0]) for r in match.candidates(pool).collect()}
    place = {r["raw_description"]: r["ord"] for r in rows.collect()}
    closed = {t for t, c in name.values() if c}
    echo = {r["raw_description"] for r in pool.filter("echo").collect()}  # another wording of a code that came before
    # a pair is asked for from its later text
    want = {(a, b) for (a, b), d in all_decisions(spark, rows).items() if d["verdict"] != "distinct" and place[b] < place[a] and not (a in closed and b in closed) and not {a, b} & echo}
    assert want == {p for p in got if p[0] != p[1]} and len(want) > 100


LONG = "FOR ROTARY KILN DRIVE ASSEMBLY LEFT HAND SIDE SPARE CASING LINER GUIDE PLATE OF SECOND STAGE CRUSHER UNIT"
NUTS = [f"HEX NUT {LONG}", f"HEX NUT M12 {LONG}", f"HEX NUT M12 BRASS {LONG}", f"HEX NUT M12 MS {LONG}", f"HEX NUT M16 {LONG}", f"HEX NUT M12 {LONG} ISO 4032", f"HEX NUT M12 {LONG} Q", f"HEX NUT SPECIAL {LONG}"]
SHORT = ["HEX NUT M12 SS304 DIN934", "HEX NUT M12 SS304 ISO4032", "NUT HEXAGON M12 STAINLESS 304 DIN 934", "HEX NUT M12 SS316", "HEX NUT ODD ONE", "HEX NUT ODD ONE Q", "HEX NUT M16 MS", "MYSTERY WIDGET KIT", "MYSTERY WIDGET KIT Q"]


@pytest.mark.parametrize("seed", range(6))
def test_mapping_is_that_of_a_run_row_by_row(spark, seed):
    rng = random.Random(seed)
    texts = [rng.choice(NUTS + SHORT if seed % 2 else NUTS) for _ in range(60)]
    rows = coded(spark, texts)
    want = row_by_row(rows.collect(), all_decisions(spark, rows))
    assert mapped(spark, rows) == want


def test_order_matters_where_two_items_end_under_one_open_one(spark, monkeypatch):
    """The second complete item is no candidate for later rows; blocks without such a case are not played again."""
    played = []
    real = match.replay
    monkeypatch.setattr(match, "replay", lambda rows, decided: played.append(sorted({r["block"] for r in rows.collect()})) or real(rows, decided))
    texts = [NUTS[0], NUTS[1], NUTS[2], NUTS[3], NUTS[2], NUTS[7], NUTS[3], *SHORT, "HEX BOLT M12 X 50 SS304"]
    rows = coded(spark, texts)
    want = row_by_row(rows.collect(), all_decisions(spark, rows))
    assert mapped(spark, rows) == want
    assert played and all(len(b) == 1 for b in played)
    played.clear()
    mapped(spark, coded(spark, SHORT * 2))
    assert not played


def test_another_decision_may_be_passed(spark):
    """A decider that calls everything of one grade the same; it sees the pairs that the joins form."""

    def decide(pairs):
        return f"SELECT a, b, 1.0D AS sim, 99 AS rule_no, CASE WHEN a.a_grade = b.a_grade THEN 'duplicate' ELSE 'distinct' END AS verdict, 0.5D AS confidence, 'rule' AS stage, 'LOW' AS safety_risk, true AS needs_review, 'same grade' AS reason FROM {pairs}"

    rows = coded(spark, ["HEX NUT M12 SS304 DIN934", "HEX NUT M12 SS304 ISO4032", "HEX NUT M12 SS316"])
    got = {r["ord"]: r for r in match.map_materials(rows, decide).collect()}
    assert (got[1]["verdict"], got[1]["rule_no"], got[1]["matched_ord"], got[1]["status"]) == ("duplicate", 99, 0, "pending-review")
    assert got[2]["verdict"] == "distinct" and match.map_materials(rows.limit(0)).count() == 0


def test_texts_are_compared_without_grouping_or_sorting_their_words(spark):
    rng = random.Random(7)
    texts = [rng.choice(NUTS + SHORT) for _ in range(60)]
    rows = coded(spark, texts)
    once = V.coded_texts(rows.select("raw_description"))
    slim = V.code_materials(rows.select("ord", "cpse_id", "own_code", "uom", "quantity", "unit_price", "raw_description"), match.told(once))
    assert not {"ctoks", "grams", "gram_set", "toks"} & set(slim.columns)
    want = {r["raw_description"]: r for r in match.pool_texts(rows).drop("tid").collect()}
    assert {r["raw_description"]: r for r in match.pool_texts(slim, once).drop("tid").collect()} == want and len(want) == len(set(texts))
    assert {r["ord"]: r for r in match.map_materials(slim, texts=once).collect()} == {r["ord"]: r for r in match.map_materials(rows).collect()}
    plan = match.texts_of(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "any_value" not in plan
    related = derived.Relations(spark, "/root/testdata/sf0.001")
    assert related.spark.table(related.view("judged")).count() and not {"gram_set", "ctoks", "toks"} & set(spark.table(related.view("m")).columns)


def test_no_table_of_rows_is_broadcast(spark, tiny, monkeypatch):
    plans = {}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def noted(df, name, *more, kept=match.materialise):
        plans.setdefault(name, plan(df))
        return kept(df, name, *more)

    monkeypatch.setattr(match, "materialise", noted)
    monkeypatch.setattr(pointers, "materialise", noted)
    relations = derived.Relations(spark, tiny)
    relations.view("mapping")
    assert "BroadcastHashJoin [ord" not in plans["linked"] and "ShuffledHashJoin [raw_description" in plans["linked"]
    assert all("Broadcast" not in plans[name] for name in ("mapping", "pointers"))
    assert "Broadcast" not in plan(relations.labelled())
