import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from matforge.llm import byte_ppm, ppm
from matforge.llm import queries as llm

SCHEMA = "doc_id long, text string"
TEXTS = ["The cat sat on the mat.", "the DOG sat, été", None, "", "a a a b c", "unseen ωords here \x01 x\x01y", "cat cat mat the catalogue", "z" * 300 + " " + "z" * 299 + "y", "  cat\n\nsat\ton the mats "]


def streams(texts):
    return [b" ".join(ppm.words_of((t or "").encode())) for t in texts]


def seen_by(texts, order):
    seen = defaultdict(Counter)
    for text in texts:
        text = b" " * order + text
        for at in range(order, len(text)):
            for k in range(order + 1):
                seen[text[at - k : at]][text[at]] += 1
    return seen


def slow(text, seen, order):
    """log10 probability by definition: from the longest context down, one byte less with each escape."""
    total, text = 0.0, b" " * order + text
    for at in range(order, len(text)):
        excluded, chance = set(), 1.0
        for k in range(order, -1, -1):
            node = {s: c for s, c in seen[text[at - k : at]].items() if s not in excluded}
            n, kinds = sum(node.values()), len(node)
            off = (ppm.CERTAIN if kinds == 1 else ppm.DISCOUNT) if len(excluded) + kinds < 256 else 0
            if text[at] in node:
                chance *= (node[text[at]] - off) / n
                break
            if kinds:
                chance *= off * kinds / n
                excluded |= node.keys()
        else:
            chance /= 256 - len(excluded)
        total += math.log10(chance)
    return total


@pytest.mark.parametrize(("order", "common", "step"), [(5, 1 << 20, 2 << 20), (5, 40, 64), (2, 0, 7), (6, 8, 1000)])
def test_each_escape_goes_to_the_context_one_byte_shorter(spark, monkeypatch, order, common, step):
    monkeypatch.setattr(byte_ppm, "COMMON_RUNS", common)
    monkeypatch.setattr(byte_ppm, "PRICED_RUNS", 50)
    monkeypatch.setattr(byte_ppm, "HELD_RUNS", 500)
    monkeypatch.setattr(byte_ppm, "HELD_SUMS", 100)
    monkeypatch.setattr(byte_ppm, "RUN_BYTES", step)
    texts = TEXTS * 4 + [f"only{i} cats ma{i} the catalogues" for i in range(24)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in byte_ppm.score_documents(df, order=order).collect()}
    plain = {r["doc_id"]: r for r in ppm.score_documents(df).collect()}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    spelt = streams(texts)
    seen = seen_by([s for s, h in zip(spelt, held) if not h], order)
    assert len(got) == len(texts)
    for i, text in enumerate(spelt):
        assert got[i]["score"] == pytest.approx(slow(text, seen, order), rel=1e-9)
        assert all(got[i][c] == plain[i][c] for c in ("held_out", "n_tokens", "n_known", "train_tokens")) and got[i]["base_score"] == pytest.approx(plain[i]["base_score"], abs=1e-9)


def test_probabilities_of_a_byte_sum_to_one_in_every_context():
    texts = [b"abc abd \t", b"abab cab \t", bytes(range(256)), bytes(range(255, -1, -1))]
    flat = np.concatenate([c for c, _ in byte_ppm.run_codes([[t] for t in texts], 5)])
    contexts = {int(c) >> 8 for c in flat} | {int.from_bytes(x, "big") for x in (b"     ", b" abab", b"\x01\x02qab", b"xxxxx")}
    pairs = np.bincount(flat & 0xFFFF, minlength=1 << 16).reshape(256, 256)
    codes = np.array(sorted(c << 8 | s for c in contexts for s in range(256)), dtype=np.int64)
    n = Counter(flat.tolist())
    chances = 10 ** byte_ppm.run_costs(codes, np.array([n[c] for c in codes.tolist()]), pairs, 5)
    assert chances.reshape(-1, 256).sum(axis=1) == pytest.approx(1)


def test_the_query_reads_contexts_across_words(spark, tiny, small):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    spelt = {r["doc_id"]: s for r, s in zip(docs, streams([r["text"] for r in docs]))}
    seen = seen_by([s for i, s in spelt.items() if zlib.crc32(str(i).encode()) % 10], 5)
    got = {r["doc_id"]: r["score"] for r in llm.op7_ppm(spark, tiny).collect()}
    short = sorted((i for i in spelt if len(spelt[i]) < 3000), key=lambda i: (zlib.crc32(str(i).encode()) % 10, i))[:30]
    assert len(got) == len(spelt) and len(short) > 5
    assert [got[i] for i in short] == pytest.approx([slow(spelt[i], seen, 5) for i in short], rel=1e-9)
    held = [r for r in llm.op7_ppm(spark, small).collect() if r["held_out"]]
    model, base, n = (sum(r[c] for r in held) for c in ("score", "base_score", "n_tokens"))
    print(f"held out, log10 a token: PPM {model / n:.3f}, word frequencies {base / n:.3f}")
    assert model > 1.01 * base


def test_odd_rows_and_orders(spark):
    odd = spark.createDataFrame([(0, None), (1, ""), (2, " \t\n"), (3, "w " * 20_000), (None, "a b"), (7, "same"), (7, "same"), (8, "x" * 5000)], SCHEMA)
    got = byte_ppm.score_documents(odd).collect()
    assert len(got) == 8 and all(math.isfinite(r["score"]) for r in got) and len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    assert len({r["score"] for r in got if r["doc_id"] in (0, 1, 2)}) == 1 and byte_ppm.score_documents(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="order"):
        byte_ppm.score_documents(odd, order=7)


def test_counting_takes_little_memory_whatever_is_counted():
    """Of many distinct words and runs a task holds some tens of megabytes, and adds up the same counts."""
    rng = np.random.default_rng(7)
    texts = [b" ".join(w.tobytes() for w in rng.integers(97, 123, (20_000, 8), dtype=np.uint8)).decode() for _ in range(26)]
    batches = pa.Table.from_pydict({"doc_id": list(range(26)), "text": texts}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())])).to_batches(max_chunksize=8)
    for summed, column, least, most in ((ppm.summed_tokens, "token", 0.5e6, 90e6), (lambda b: byte_ppm.summed_runs(b, 5), "code", 4e6, 90e6)):
        tracemalloc.start()
        before, rows, everywhere = tracemalloc.get_traced_memory()[0], 0, 0
        tracemalloc.reset_peak()
        for out in summed(iter(batches)):
            rows, everywhere = rows + out.num_rows, everywhere + pc.sum(out.column("everywhere")).as_py()
            assert pc.all(pc.less_equal(out.column("trained"), out.column("everywhere"))).as_py()
        peak = tracemalloc.get_traced_memory()[1] - before
        tracemalloc.stop()
        print(f"{column}: {rows} rows, {peak / 1e6:.0f} MB")
        assert rows > least and everywhere == sum(len(t) + 2 if column == "code" else t.count(" ") + 2 for t in texts) and peak < most
