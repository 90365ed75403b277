"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from matforge.llm import queries as llm
from matforge.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, item_id int, term string, score string, rank int, bundle int, block string"


def brute(docs, items, k=10):
    """docs, items: (id, text) rows."""
    terms = lambda text: TERM.findall((text or "").translate(UPPER))
    read = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in read), sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    wants = {}
    for i, t in items:
        wants.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, want in wants.items():
        scored = []
        for doc, c in read:
            score, n = 0, sum(c.values())
            for t, times in want.items():
                if c[t]:
                    w, m = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))), 25 + 75 * n * n_docs // total
                    score += times * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        out += [(item, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def pairs(df, id_col):
    return [tuple(r) for r in df.select(id_col, "text").collect()]


def test_every_item_over_all_documents(spark, tiny):
    docs, items = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    got = llm.op11_ranked_search(spark, tiny)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(pairs(docs, "doc_id"), pairs(items, "item_id"))


def test_oracle_agrees(spark, tiny):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tiny}/{name}.parquet')")
    assert sorted(con.execute(llm.oracle_sql()["op11_ranked_search"]).fetchall()) == sorted(map(tuple, llm.op11_ranked_search(spark, tiny).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_nothing_is_lost_on_the_way(spark, monkeypatch, seed):
    """Small blocks and bundles, several rounds, odd texts, ties and repeated rows."""
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 7)
    monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", 60)
    monkeypatch.setattr(ranked_search, "BUNDLE_TERMS", 25)
    monkeypatch.setattr(ranked_search, "ROUND_BUNDLES", 2)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["\u00c9t\u00e9", "CASE", "case", "x_y", "a\u00a0b", "\u0e01\u0e02"]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(150)] + [(500 + i, "w3 w40 w41 case") for i in range(80)]
    docs += [(None, "w40 w41"), (None, None), (7, "w40 w41"), (7, "w40 w41"), (900, ""), (901, "-- \n"), (902, "w1 " * 3000), (903, None)]
    items = [(i, text(rng.randint(1, 12))) for i in range(14)] + [(20, None), (21, "?!"), (22, "w40 w40 w41 w41"), (23, "unheard of"), (None, "w5 w6"), (None, "w5"), (2**60 + 1, "W3 \u00e9t\u00e9 \u00c9t\u00e9"), (24, "w3"), (24, "case")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, 1, "t", "s", 2, 3, "b") for i, t in docs], DOCS).repartition(3)
    ask = spark.createDataFrame([(i, t, 1.5, "d") for i, t in items], "item_id long, text string, score double, doc_id string")
    assert sorted(map(tuple, ranked_search.search(df, ask).collect()), key=str) == brute(docs, items)
    assert sorted(map(tuple, ranked_search.search(df, ask, k=2, owners=()).collect()), key=str) == brute(docs, items, 2), "a single owner"
    assert ranked_search.search(df.limit(0), ask).count() == 0 and ranked_search.search(df, ask.limit(0)).count() == 0


def test_accumulators_shrink(spark, tiny, monkeypatch):
    """Most documents that hold a common term of an item never get an accumulator."""
    sizes = []
    real = ranked_search._floors

    def watched(spark, accumulators, needs, k):
        sizes.append(sum(len(r["scores"]) // 8 for r in accumulators.select("scores").collect()))
        return real(spark, accumulators, needs, k)

    monkeypatch.setattr(ranked_search, "_floors", watched)
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    ranked_search.search(docs, items).collect()
    assert len(sizes) == 4 and sizes[-1] < 0.2 * docs.count() * items.count()


def test_final_ranking_is_limited_before_its_shuffle(spark, tiny):
    plan = llm.op11_ranked_search(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
