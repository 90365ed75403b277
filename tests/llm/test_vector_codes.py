"""Vector codes against brute force over all parts and entries, and odd tables."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matforge.llm import queries as llm
from matforge.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int, ids int, error long, slot string"


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label) to be coded."""
    ids = sorted(range(len(rows)), key=lambda i: rows[i][0])
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in r[1]] for r in rows]).reshape(len(rows), parts, -1)
    books = x[ids[:entries]].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        away = ((x[:, :, None] - books[None]) ** 2).sum(3)
        code = away.argmin(2)
        if turn < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    mine = x[code[:, p] == e, p]
                    if len(mine):
                        books[p, e] = mine.sum(0) // len(mine)
    error = away.min(2).sum(1)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    return sorted((r[0], "".join(f"{c:02x}" for c in cs), int(e), by_label[r[2]], digest) for r, cs, e in zip(rows, code, error))


def test_codes_of_all_vectors(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = llm.op13_vector_codes(spark, tiny)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_oracle_agrees(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tiny}/embeddings.parquet')")
    assert sorted(con.execute(llm.oracle_sql()["op13_vector_codes"]).fetchall()) == sorted(map(tuple, llm.op13_vector_codes(spark, tiny).collect()))


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 7)  # many small blocks
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(v)) for v in rng.normal(0, 0.2, 32)], None if i % 5 == 0 else i % 3) for i in range(90)]
    good += [(200 + i, good[1][1], 1) for i in range(60)]  # one vector again and again
    same = good[2][1]
    bad = [(300, None, 1), (301, [], 1), (302, [None] * 32, 1), (303, [float("nan")] * 32, 1), (304, [float("inf")] + same[1:], 1), (305, same[:16], 1), (306, same[:31], 1), (307, [3.0e38] * 32, 1)]
    frame = spark.createDataFrame([(*r, "c", 1, 2, 3, "s") for r in good + bad], SCHEMA)
    assert sorted(map(tuple, vector_codes.code_vectors(frame).collect())) == brute(good)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, vector_codes.code_vectors(frame).collect())) == brute(good), "labels joined by a shuffle"
    assert vector_codes.code_vectors(frame.limit(0)).count() == 0 and vector_codes.code_vectors(frame.filter("vec_id >= 300")).count() <= 1
    few = spark.createDataFrame([(*r, "c", 1, 2, 3, "s") for r in [*good[:5], (None, same, None)]], SCHEMA)
    got = {r["vec_id"]: r["error"] for r in vector_codes.code_vectors(few).collect()}
    assert set(got) == {0, 1, 2, 3, 4, None} and got[None] == 0 and not any(got.values()), "each vector is an entry"


@given(st.integers(1, 400), st.integers(1, 5), st.integers(1, 60), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_trees_assign_as_brute_force(n, width, spread, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread + 1, (n, width)).astype(np.int32)
    entries = rng.integers(-spread, spread + 1, (rng.integers(1, 65), width))
    tree = vector_codes.grow_tree(points)
    tree = {name: tree[name].astype(kind) for name, kind in vector_codes.FIELDS.items()}
    away = ((points[:, None].astype(np.int64) - entries[None]) ** 2).sum(2)
    codes, errors = vector_codes._assign(tree, entries)
    assert (codes == away.argmin(1)).all() and (errors == away.min(1)).all()
    totals, counts = np.zeros(entries.shape, dtype=np.int64), np.zeros(len(entries), dtype=np.int64)
    vector_codes._add(tree, entries, totals, counts)
    assert (counts == np.bincount(codes, minlength=len(entries))).all()
    assert all((totals[e] == points[codes == e].sum(0)).all() for e in range(len(entries)))


def test_balls_hold_their_points():
    rng = np.random.default_rng(1)
    points = np.floor(rng.normal(0, 30, (3000, 4))).astype(np.int32)
    tree = vector_codes.grow_tree(points)
    assert sorted(tree["place"]) == list(range(3000)) and (points[tree["place"]] == tree["points"]).all()
    for i in range(len(tree["radius"])):
        mine = tree["points"][tree["begin"][i] :][: tree["count"][i]]
        assert (tree["total"][i] == mine.sum(0)).all()
        assert np.sqrt(((mine - mine.sum(0) / len(mine)) ** 2).sum(1).max()) <= tree["radius"][i] * (1 + 1e-9)
    owned, _, leaves, lists = vector_codes._walk(tree, points[:8].astype(np.int64) * 10)
    assert len(owned) and tree["count"][owned].sum() + tree["count"][leaves].sum() == 3000


@pytest.mark.parametrize("partitions", [1, 9])
def test_codes_do_not_depend_on_blocks(spark, tiny, partitions):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet").repartition(partitions)
    assert sorted(map(tuple, vector_codes.code_vectors(df).collect())) == sorted(map(tuple, llm.op13_vector_codes(spark, tiny).collect()))
