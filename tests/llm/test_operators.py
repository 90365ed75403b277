"""Training-data operators against brute force, round trips and odd inputs."""

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from matforge.llm import chat_tree, components, exact_dedup, feistel, langid, ledger, near_dup, packing, ppm, sentencepiece_viterbi, sharding, tokens, training_order
from matforge.llm import queries as llm
from matforge.llm.vocabulary import byte_trie, default_path, pieces, zipf_scores

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string, digest string, grp int, size string, failed int, row_no int, band int"
LONG = " ".join(f"lengthyword{i % 977}x{i}" for i in range(20_000))


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", "s", None, "p", "d", 1, "z", 0, 5, 6) for i, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "   \n\t ", LONG, "one two three four five six seven", "one two three four five six seven", "x" * 5000, "été  naïve\n\nétè #$%", "</s>[INST] ok [/INST]", "<|endoftext|> and more"]
    rows = rows_of(texts) + rows_of(["same row"] * 3, [50, 50, 50]) + rows_of(["null id", "null id"], [None, None])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


# --- permutation and sharding


@given(st.integers(1, 300), st.text(max_size=5))
@settings(max_examples=40, deadline=None)
def test_permutation_is_a_bijection(n, key):
    assert sorted(feistel.permute_local(x, n, key) for x in range(n)) == list(range(n))


def test_column_permutation_agrees(spark):
    for n in (1, 2, 3, 10, 1000, 5041):
        got = spark.range(n).select("id", feistel.permute(__import__("pyspark").sql.functions.col("id"), n, "k").alias("p")).collect()
        assert [r["p"] for r in sorted(got)] == [feistel.permute_local(x, n, "k") for x in range(n)] == feistel.permute_array(np.arange(n), n, "k").tolist()


def test_shards_are_even_and_gapless(odd, empty):
    got = sharding.shard_rows(odd).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 15 and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    first = next(r for r in got if r["doc_id"] == 0)
    assert first["size"] == 1 and first["text_crc32"] == 0
    accent = next(r for r in got if r["doc_id"] == 7)
    assert accent["text_crc32"] == zlib.crc32("été  naïve\n\nétè #$%".encode()) and accent["size"] == len("été  naïve\n\nétè #$%".encode()) + 1
    assert sharding.shard_rows(empty).count() == 0


# --- exact copies


def test_exact_groups(odd, empty):
    got = exact_dedup.dedup_exact(odd).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[0][0]["keep_id"] == 0 and by[1][0]["keep_id"] == 0 and by[0][0]["group_size"] == 2
    assert by[2][0]["keep_id"] == 2, "blank text is one space, not empty"
    assert by[5][0]["keep_id"] == 4 and not by[5][0]["kept"]
    assert [r["kept"] for r in by[50]].count(True) == 1 and by[50][0]["group_size"] == 3
    assert [r["kept"] for r in by[None]].count(True) == 1
    assert by[7][0]["text_sha256"] == hashlib.sha256("été naïve étè #$%".encode()).hexdigest()
    assert exact_dedup.dedup_exact(empty).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["0", "2", "3", "4", "6", "7", "8", "9", "50", "None"])


def test_rows_that_share_an_id_stay_apart(spark):
    rows = rows_of(["a b", "c d", "a  b", "c d", "e", "e", "f", None], [3, 7, 7, 7, None, None, 7, 7])
    df = spark.createDataFrame(rows, SCHEMA)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(3, "a b"), (7, "c d"), (None, "e"), (7, "f"), (7, None)])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_index_says_which_batch_won(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    make = lambda texts, ids: spark.createDataFrame(rows_of(texts, ids), SCHEMA)
    assert [r["kept"] for r in exact_dedup.dedup_exact(make(["n", "a"], [None, 5]), index, batch="first").collect()] == [True, True]
    later = exact_dedup.dedup_exact(make(["n", "a", "a", "b"], [None, 5, 2, None]), index).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["kept"]) for r in later) == [(-1, -1, False), (-1, -1, True), (2, 5, False), (5, 5, False)]
    again = exact_dedup.dedup_exact(make(["n", "a"], [None, 5]), index, batch="first").collect()
    assert all(r["kept"] for r in again), "a batch that is run again under its name is answered alike"
    assert exact_dedup.drop_copies(make(["n", "a", "z"], [None, 5, 6]), index).count() == 1
    before = sorted(map(tuple, index.table().collect()))
    index.compact(buckets=5)
    assert sorted(map(tuple, index.table().collect())) == before and exact_dedup.DigestIndex(spark, index.name, path=index.path).buckets == 5
    assert len(index.table().inputFiles()) <= 5
    index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_index_remembers_earlier_batches(spark):
    index = exact_dedup.DigestIndex(spark)
    first = exact_dedup.dedup_exact(spark.createDataFrame(rows_of(["a b", "c"], [10, 11]), SCHEMA), index).collect()
    later = exact_dedup.dedup_exact(spark.createDataFrame(rows_of(["a  b", "d", "d"], [3, 7, 5]), SCHEMA), index).collect()
    assert all(r["kept"] for r in first)
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in later} == {3: (10, False), 7: (5, False), 5: (5, True)}
    assert index.table().count() == 3
    plan = index.table().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, "the bucketed index is read without a shuffle"
    index.drop()


# --- quality rules


def slow_measures(text):
    words = (text or "").encode().split()
    n = len(words)
    windows = defaultdict(list)
    for i in range(n - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().strip()]
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n#é", max_size=120)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_measures_match_brute_force(texts):
    got = ledger.measure([None if t is None else t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert tuple(int(got[m][k]) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == slow_measures(t)


def test_ledger_policies_and_ablation(odd, empty):
    book = ledger.ledger(odd).cache()
    by = {r["doc_id"]: r for r in book.collect()}
    assert book.count() == 15 and by[0]["n_words"] == 0 and by[0]["failed"] & 1 and by[3]["n_words"] == 20_000
    table = {r["rule"]: r for r in ledger.ablation(book).collect()}
    assert table["too_short"]["failed"] == sum(r["failed"] & 1 for r in book.collect())
    kept = ledger.keep_passing(odd)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.collect()] == [3]
    assert ledger.ledger(empty).count() == 0 and ledger.keep_passing(empty).count() == 0


def test_rules_leave_good_documents(spark, small):
    book = ledger.ledger(spark.read.parquet(f"{small}/documents.parquet")).filter(ledger.rejects(ledger.PRODUCTION) & ~ledger.rejects(ledger.BASE))
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert book.join(labels, "doc_id").filter("quality = 1").count() <= 2


# --- chat


@given(st.text(alphabet="\\[]<>/sTURNé \n", max_size=60))
@settings(max_examples=200, deadline=None)
def test_escape_is_reversible(text):
    formatted = "".join(chat_tree.turn_parts("user", text))
    ids, at, length = chat_tree.turn_ids("user", text)
    assert chat_tree.unescape(chat_tree.escape(text)) == text
    assert [m[2] for m in chat_tree.TURN.finditer(formatted)] == [chat_tree.escape(text)]
    assert "[INST]" not in chat_tree.escape("[INST]") and "</s>" not in chat_tree.escape("</s>")
    assert tokens.fast().decode(ids) == formatted and tokens.fast().decode(ids[at : at + length]) == chat_tree.escape(text)


def test_prefix_tree_shares_and_reads_back(spark):
    turns = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("system", "S"), ("user", "hello"), ("assistant", f"a{c % 3}"), ("user", None), ("assistant", "[x]")][: 2 + c % 4])]
    turns += [(None, 0, "user", "alone"), (None, 0, "user", "alone too"), (99, 0, "assistant", "twice"), (99, 0, "assistant", "twice"), (100, None, "user", "y" * 100_000)]
    random.Random(1).shuffle(turns)
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, path string")
    segments = chat_tree.build_segments(df)
    rows = segments.collect()
    shared = sum(len(s["nodes"]) for s in rows)
    assert shared < len(turns)
    for s in rows:
        assert s["ids"] == [i for n in s["nodes"] for i in s["ids"][n["start"] : n["start"] + n["length"]]], "nodes lie one after the other"
        for node in s["nodes"]:
            spelt = tokens.fast().decode(s["ids"][node["start"] : node["start"] + node["length"]])
            assert chat_tree.TURN.fullmatch(spelt) and (node["loss_length"] > 0) <= spelt.startswith("[TURN assistant]")
            assert node["position"] == sum(i["end"] - i["start"] for i in node["attends"])
            assert all(i["end"] <= node["start"] for i in node["attends"])
    back = chat_tree.read_back(segments).collect()
    assert sorted(r["formatted_chars"] for r in back if r["conv_id"] is None) == [len("[TURN user]alone[/TURN]"), len("[TURN user]alone too[/TURN]")]
    got = {r["conv_id"]: r for r in back if r["conv_id"] is not None}
    turns = [t for t in turns if t[0] is not None]
    whole = defaultdict(list)
    for c, t, r, x in turns:
        whole[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(whole)
    for c, parts in whole.items():
        parts.sort()
        loss = "".join(x for _, r, x in parts if r == "assistant")
        assert got[c]["n_turns"] == len(parts) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in parts).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len("".join(chat_tree.turn_parts(r, x))) for _, r, x in parts)
    assert chat_tree.build_segments(df.limit(0)).count() == 0


# --- near copies


def slow_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    label = list(range(len(texts)))
    postings = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            postings[x].append(i)
    pairs = {p for at in postings.values() for p in itertools.combinations(at, 2)}
    for i, j in sorted(pairs):
        a, b = sets[i], sets[j]
        shared = a.keys() & b.keys()
        if len(shared) >= 0.8 * len(a.keys() | b.keys()) or near_dup.probability_jaccard(a, b) >= 0.8:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return label


def variants(seed, n, base_words=120, edits=4):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(base_words)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_classes_match_brute_force(spark, documents, monkeypatch):
    texts = [r["text"] for r in documents.orderBy("doc_id").collect()]
    texts += variants(1, 60) + variants(2, 5) + ["a b c", "a b c", "a b", None, "", " ", "z " * 300, "z " * 301, LONG, LONG + " tail"]
    monkeypatch.setattr(near_dup, "BLOCK", 16)  # so that the group of variants spans blocks
    monkeypatch.setattr(near_dup, "STAR", 8)
    got = near_dup.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    assert len(got) == len(texts)
    assert [r["class_id"] for r in sorted(got)] == slow_classes(texts)


def test_copies_with_repeated_lines_are_found(spark):
    texts = []
    for seed, times in enumerate((20, 40, 60, 80, 100)):
        w = variants(10 + seed, 0, 204)[0].split()
        texts += [" ".join(w), " ".join(w[:90] + w[90:102] * times + w[102:])]
    got = near_dup.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    assert [r["class_id"] for r in sorted(got)] == slow_classes(texts) == [0, 0, 2, 2, 4, 4, 6, 6, 8, 8]


def test_links_beside_the_hub_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "BROADCAST_KEYS", 0)
    rng, texts = random.Random(8), []
    passage = [f"p{i}" for i in range(150)]
    for k in range(30):  # a passage that all share, and a tail that each two share: the pairs are near, the rest is not
        tail = [f"t{k // 2}x{i}" for i in range(60)]
        texts.append(" ".join(passage + tail + [f"own{k}x{rng.random()}"]))
    got = near_dup.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    assert [r["class_id"] for r in sorted(got)] == slow_classes(texts) == [k // 2 * 2 for k in range(30)]


def test_texts_that_share_an_id(spark):
    a, b, c = (variants(30 + k, 0)[0] for k in range(3))
    rows = rows_of([a, a + " x", b, c, c, None, b], [3, 7, 7, 9, 9, 7, None])
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"] or -1, r["class_id"] or -1, r["kept"]) for r in near_dup.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (3, 3, True), (7, 3, False), (7, 7, True), (7, 7, True), (9, 9, True), (9, 9, True)]
    kept = near_dup.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(3, a), (7, b), (7, None), (9, c), (9, c), (None, b)])


def test_recall_of_near_pairs(spark, small):
    """Every pair that brute force links ends in one class, on whole texts."""
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    got = [r["class_id"] for r in sorted(near_dup.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect())]
    want = slow_classes(texts)
    near = [i for i, x in enumerate(want) if x != i]
    assert len(near) > 50 and sum(got[i] == want[i] for i in near) >= 0.99 * len(near)
    assert all(want[i] == want[x] for i, x in enumerate(got))


def test_near_copies_odd_rows(odd, empty):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == 15 and near_dup.near_duplicates(empty).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[5]["class_id"] == 4 and not by[5]["kept"] and by[0]["kept"] and by[1]["class_id"] == 1
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    kept = near_dup.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 14 and near_dup.keep_one_of_each(empty).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(3)
    a = {i: rng.randrange(1, 4) for i in range(300)}
    b = {i: rng.randrange(1, 4) for i in range(60, 380)}
    key = np.array([*sorted(a), *sorted(b)], dtype=np.uint64) * np.uint64(2654435761)
    of = np.repeat([0, 1], [len(a), len(b)])
    weight = np.array([*[a[k] for k in sorted(a)], *[b[k] for k in sorted(b)]])
    got = near_dup.signatures(key, of, weight, 2, 4096)
    assert abs((got[0] == got[1]).mean() - near_dup.probability_jaccard(a, b)) < 0.03


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
@settings(max_examples=60, deadline=None)
def test_forest_connects_the_same(edges):
    edges = [(a, b) for a, b in edges if a != b]
    if not edges:
        return
    node, least = components.forest(*(np.array(x, dtype=np.int64) for x in zip(*edges)))
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {x: y for x, y in label.items() if x != y} == dict(zip(node.tolist(), least.tolist()))


def test_components_of_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(components, "contract_locally", lambda e: e)  # the rounds alone
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 104)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 102: 100, 104: 100}


# --- language model


def contexts_of(token, at):
    last = (b"  " + token[:at])[-2:]
    return [("word", token[:at]), last, last[1:], b""]


def slow_ppm(token, seen):
    """log10 probability of a token from context counts, by definition."""
    total = 0.0
    for at, symbol in enumerate(token):
        excluded, chance = set(), 1.0
        for context in contexts_of(token, at):
            node = {s: c for s, c in seen[context].items() if s not in excluded}
            n, kinds = sum(node.values()), len(node)
            off = (ppm.CERTAIN if kinds == 1 else ppm.DISCOUNT) if len(excluded) + kinds < 256 else 0
            if symbol in node:
                chance *= (node[symbol] - off) / n
                break
            if kinds:
                chance *= off * kinds / n
                excluded |= node.keys()
        else:
            chance /= 256 - len(excluded)
        total += math.log10(chance)
    return total


def trained_contexts(tokens_):
    seen = defaultdict(Counter)
    for token, n in tokens_.items():
        for at, symbol in enumerate(token):
            for context in contexts_of(token, at):
                seen[context][symbol] += n
    return seen


PPM_TEXTS = ["The cat sat on the mat.", "the DOG sat, été", None, "", "a a a b c", "unseen ωords here \x01 x\x01y", "cat cat mat the catalogue", "z" * 300 + " " + "z" * 299 + "y"]


@pytest.mark.parametrize("stretch", [1 << 20, 4])
def test_scores_match_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(ppm, "STRETCH_TOKENS", stretch)
    texts = PPM_TEXTS * 6 + [f"only{i} cats ma{i}" for i in range(30)]
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in ppm.score_documents(df).collect()}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    lower = [(t or "").encode().lower() for t in texts]
    words = Counter(w for t, h in zip(lower, held) if not h for w in ppm.words_of(t))
    n, v = sum(words.values()), len(words)
    seen = trained_contexts({ppm.spelt(w): c for w, c in words.items()})
    for i, t in enumerate(lower):
        own = ppm.words_of(t)
        assert got[i]["held_out"] == held[i] and got[i]["n_tokens"] == len(own) and got[i]["train_tokens"] == n
        assert got[i]["n_known"] == sum(words[w] > 0 for w in own)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs=1e-6)
        assert got[i]["score"] == pytest.approx(sum(slow_ppm(ppm.spelt(w), seen) for w in own), rel=1e-6)


@given(st.dictionaries(st.binary(min_size=0, max_size=5).filter(lambda w: not w.split() or w.split()[0] == w and w), st.integers(0, 5), min_size=1, max_size=12), st.integers(0, 3))
@settings(max_examples=40, deadline=None)
def test_stretches_price_like_one_trie(words, cut):
    words = {ppm.spelt(w or ppm.END): n for w, n in words.items()}
    order = sorted(words)
    seen = trained_contexts({t: n for t, n in words.items() if n})
    tokens_, trained = ppm.Tokens(order), np.array([words[t] for t in order])
    codes = tokens_.context * 256 + tokens_.flat
    names, at = np.unique(codes, return_inverse=True)
    n = np.bincount(at, weights=np.repeat(trained, tokens_.sizes))
    short = ppm.short_contexts(names[n > 0], n[n > 0])
    want = [slow_ppm(t, seen) for t in order]
    assert ppm.token_costs(tokens_, trained, short) == pytest.approx(want, rel=1e-5)
    cut = order[min(cut, len(order) - 1)]
    k = order.index(cut)
    common = {cut[:j]: {s: c for s, c in seen["word", cut[:j]].items() if c} for j in range(len(cut) + 1)}
    for part, cuts in ((slice(0, k), (None, cut)), (slice(k, None), (cut, None))):
        if order[part]:
            assert ppm.token_costs(ppm.Tokens(order[part]), trained[part], short, cuts, common) == pytest.approx(want[part], rel=1e-5)


def test_probabilities_sum_to_one():
    tokens_ = Counter({ppm.spelt(w): n for w, n in {b"ab": 3, b"ac": 1, b"b": 2, ppm.END: 4}.items()})
    seen = trained_contexts(tokens_)
    for prefix in (b"", b"a", b"ab", b"abq", b"q"):
        assert sum(10 ** (slow_ppm(prefix + bytes([s]), seen) - slow_ppm(prefix, seen)) for s in range(256)) == pytest.approx(1)


def test_rare_words_meet_their_counts(spark, documents, monkeypatch):
    monkeypatch.setattr(ppm, "COMMON_SHARE", 1 / 50)
    monkeypatch.setattr(ppm, "BUCKET_POSTINGS", 1000)
    few = {r["doc_id"]: r for r in ppm.score_documents(documents).collect()}
    monkeypatch.setattr(ppm, "COMMON_SHARE", 0.0)
    all_common = {r["doc_id"]: r for r in ppm.score_documents(documents).collect()}
    for i, r in few.items():
        assert r["score"] == pytest.approx(all_common[i]["score"], rel=1e-9)
        assert r["n_known"] == all_common[i]["n_known"] and r["base_score"] == pytest.approx(all_common[i]["base_score"], abs=1e-6)


def test_model_predicts_held_out_texts(spark, small):
    got = [r for r in ppm.score_documents(spark.read.parquet(f"{small}/documents.parquet")).collect() if r["held_out"]]
    model, base, n = (sum(r[c] for r in got) for c in ("score", "base_score", "n_tokens"))
    print(f"held out, log10 a token: PPM {model / n:.3f}, word frequencies {base / n:.3f}")
    # word frequencies spend the share of all unseen words on each of them, so they sum to more than one
    assert model > 1.08 * base


def test_adaptive_mode_and_odd_rows(odd, empty):
    assert ppm.adaptive_score(b"abc abc abc abc") > ppm.adaptive_score(b"abq czk xwv uts")
    assert ppm.adaptive_score(None) == ppm.adaptive_score(b"") == pytest.approx(-math.log10(256))
    assert ppm.score_adaptively(odd).count() == 15 and ppm.score_adaptively(empty).count() == 0
    got = sorted(ppm.score_documents(odd).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == 15 and ppm.score_documents(empty).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_tokens"] == by[1]["n_tokens"] == by[2]["n_tokens"] == 1 and by[3]["n_tokens"] == 20_001 and by[0]["score"] == by[2]["score"]
    assert len({r["score"] for r in got if r["doc_id"] == 50}) == 1


# --- pieces


def slow_viterbi(word):
    """The best score of a marked word, over all segmentations into pieces and bytes."""
    texts, _ = pieces(default_path())
    score, byte_score = sentencepiece_viterbi.scores(default_path())
    known = {t.encode(): float(score[i]) for i, t in enumerate(texts) if t is not None}
    longest = max(map(len, known))
    best = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        best[j] = best[j - 1] + byte_score
        for i in range(max(0, j - longest), j):
            if word[i:j] in known:
                best[j] = max(best[j], best[i] + known[word[i:j]])
    return best[-1]


def score_of(ids):
    score, byte_score = sentencepiece_viterbi.scores(default_path())
    bytes_ = set(pieces(default_path())[1].tolist())
    return sum(byte_score if i in bytes_ else float(score[i]) for i in ids)


@given(st.lists(st.text(alphabet="abethin ▁é漢 ", max_size=14), max_size=8))
@settings(max_examples=60, deadline=None)
def test_shared_prefix_viterbi_is_optimal(texts):
    words = list({w.encode() for t in texts for w in sentencepiece_viterbi.marked(t)})
    ids, ends = sentencepiece_viterbi.encode_distinct(words, default_path())
    for k, word in enumerate(words):
        own = ids[ends[k] : ends[k + 1]].tolist()
        assert score_of(own) == pytest.approx(slow_viterbi(word))
        assert sentencepiece_viterbi.decode(own, default_path()) == word.decode().replace("▁", " ")[1:]


def test_long_words_and_ties():
    words = [("the" * 40).encode(), "漢字かな交じり文".encode() * 30, b"x" * 70, b"x" * 71, b"x", "▁the".encode()]
    ids, ends = sentencepiece_viterbi.encode_distinct(words, default_path())
    for k, word in enumerate(words):
        assert score_of(ids[ends[k] : ends[k + 1]].tolist()) == pytest.approx(slow_viterbi(word))
    assert sentencepiece_viterbi.encode_distinct([], default_path())[0].tolist() == []


def test_pieces_round_trip(odd, empty, documents):
    encoded = sentencepiece_viterbi.encode_documents(odd.unionByName(documents, allowMissingColumns=True))
    back = {(r["doc_id"], r["text"]) for r in sentencepiece_viterbi.decode_documents(encoded).collect()}
    assert all(r["round_trip"] for r in encoded.collect())
    assert {(r["doc_id"], r["text"] or "") for r in odd.collect()} <= back
    assert sentencepiece_viterbi.encode_documents(empty).count() == 0


# --- languages


def test_forward_sums_all_segmentations():
    path = default_path()
    texts, single = pieces(path)
    known = {t.encode(): i for i, t in enumerate(texts) if t is not None}
    rng = np.random.default_rng(0)
    probability = rng.random((len(texts), 2)) / len(texts)

    def total(word, lang):
        logs = [0.0] + [-math.inf] * len(word)
        for j in range(1, len(word) + 1):
            ways = [logs[i] + math.log(probability[known[word[i:j]], lang]) for i in range(max(0, j - 60), j) if word[i:j] in known]
            ways.append(logs[j - 1] + math.log(probability[single[word[j - 1]], lang]))
            logs[j] = np.logaddexp.reduce(ways)
        return logs[-1]

    rng = random.Random(5)
    long = ["".join(rng.choice("abcdefghijklmnopé漢") for _ in range(n)).encode() for n in (33, 70, 300, 2000)]
    words = [b"the", "été".encode(), b"a", b"thenation", "漢".encode(), *long]
    got = langid.log_likelihoods(words, probability, path)
    for k, w in enumerate(words):
        assert got[k] == pytest.approx([total("▁".encode() + w, lang) for lang in (0, 1)])
    counts = langid.expected_counts(words, np.ones((len(words), 2)), probability[:, 0], path)
    spelt = sum(counts[i, 0] * (1 if t is None else len(t.encode())) for i, t in enumerate(texts))
    assert spelt == pytest.approx(sum(len("▁".encode() + w) for w in words))
    assert byte_trie(path)[1].max() < len(texts)


def test_expected_counts_match_brute_force():
    texts, single = pieces(default_path())
    known = {t.encode(): i for i, t in enumerate(texts) if t is not None}
    probability = np.random.default_rng(1).random(len(texts)) / 50
    rng = random.Random(6)
    for n in (3, 40, 150):
        word = ("▁" + "".join(rng.choice("thenasio") for _ in range(n))).encode()
        ways = [[(j - 1, single[word[j - 1]])] + [(i, known[word[i:j]]) for i in range(j) if word[i:j] in known] for j in range(1, len(word) + 1)]
        front = [1.0] + [0.0] * len(word)
        for j, own in enumerate(ways, 1):
            front[j] = sum(front[i] * probability[p] for i, p in own)
        back = [0.0] * len(word) + [1.0]
        for j in range(len(word), 0, -1):
            for i, p in ways[j - 1]:
                back[i] += probability[p] * back[j]
        want = np.zeros(len(texts))
        for j, own in enumerate(ways, 1):
            for i, p in own:
                want[p] += front[i] * probability[p] * back[j] / front[-1]
        got = langid.expected_counts([word[3:], b"other"], np.array([[1.0], [0.0]]), probability, default_path())
        assert np.allclose(got[:, 0], want, rtol=1e-9, atol=1e-12)


def test_language_accuracy_on_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 + 1e-9 for r in got)


def test_language_odd_rows(odd, empty, spark):
    model = langid.fit(odd)
    by = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert by[0]["lang_pred"] == "und" and by[2]["lang_pred"] == "und" and by[4]["lang_pred"] == "en"
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert langid.keep_identified(odd, model).columns == odd.columns
    assert "und" in {r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows_of(["12 34 ..", "ok"]), SCHEMA), model).collect()}


def test_rare_language_is_fitted_from_a_small_sample(spark):
    texts = [f"the house and the river number {i}" for i in range(3000)] + ["huset ligger ved floden og skoven"] * 10
    df = spark.createDataFrame([(i, t, "en" if i < 3000 else "da") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(df, train_docs=20)
    assert langid.predict([b"huset ved skoven", b"the house and the river"], model)[0] == ["da", "en"]
    assert langid.row_limit([3, 40, 9000], 100) == 57 and langid.row_limit([3, 400, 9000], 103) == 50 and langid.row_limit([5, 5], 1) == 1


# --- tokens, packing, training order


def test_ids_equal_the_full_tokenizer(documents):
    texts = [r["text"] for r in documents.collect()] + ["<|endoftext|>", "a<|endoftext|>b", "", "é\u00a0\u2028x 漢字 ½ ٣"]
    for t in texts:
        assert tokens.token_ids(t).tolist() == [*tokens.full().encode(t, add_special_tokens=False).ids, 0]


@given(st.lists(st.integers(1, 50), max_size=40))
@settings(max_examples=80, deadline=None)
def test_tournament_is_first_fit(sizes):
    sizes = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    bins, offsets = packing.first_fit(sizes, 50)
    used = []
    for size, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        k = next((k for k, u in enumerate(used) if u + size <= 50), len(used))
        if k == len(used):
            used.append(0)
        assert (b, o) == (k, used[k])
        used[k] += size


def check_packing(pieces_, docs):
    ids = {r["doc_id"]: tokens.token_ids(r["text"]) for r in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces_:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc])
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[doc][p["start"] : at].astype("<u4").tobytes())
        assert at == len(ids[doc])
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.LENGTH
    return sum(len(x) for x in ids.values()) / (len(by_sequence) * packing.LENGTH)


def test_tasks_stay_bounded():
    assert [packing.tasks_for(n, 8) for n in (1, 5, 100, 10_000, 10_000_000, 10**9)] == [1, 5, 8, 40, 20_000, 20_000]


def test_packing_is_exact_and_tight(documents, odd, empty):
    assert check_packing(packing.pack(documents).collect(), documents.collect()) > 0.97
    assert check_packing(packing.pack(documents, group_docs=40).collect(), documents.collect()) > 0.9
    unique = odd.filter("doc_id < 50")
    check_packing(packing.pack(unique).collect(), unique.collect())
    assert packing.pack(odd).count() >= 15 and packing.pack(empty).count() == 0


def test_training_order_round_trip(spark, documents, odd, empty, tmp_path):
    for k, df in enumerate((documents, odd)):
        layout, manifest = training_order.write_training_order(df, str(tmp_path / f"order{k}"), length=64, shard_slots=100)
        records = training_order.read_training_order(spark, layout).collect()
        assert sorted(r["slot"] for r in records) == list(range(layout.sequences)) and sum(r["slots"] for r in manifest.collect()) == layout.sequences
        records.sort(key=lambda r: r["number"])
        assert all(r["slot"] == feistel.permute_local(r["number"], layout.sequences, layout.key) for r in records)
        assert all(r["length"] == 64 for r in records[:-1])
        stream = [i for r in records for i in r["ids"]]
        texts = [[]]
        for i in stream:
            if i == training_order.CLOSE:
                texts.append([])
            else:
                texts[-1].append(i)
        assert texts.pop() == []
        order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"] or "") for r in df.collect())
        assert Counter(tokens.fast().decode(t) for t in texts) == Counter(t for _, t in order)
        if k == 0:
            assert [tokens.fast().decode(t) for t in texts] == [t for _, t in order]
            at = 0
            begins = {}
            for (_, doc), t in order:
                begins[doc] = at
                at += len(tokens.fast().encode_ordinary(t)) + 1
            assert all(begins[r["doc_id"]] + r["start"] == 64 * r["number"] for r in records)
        path, offset = layout.place(3)
        with open(tmp_path / f"order{k}" / path, "rb") as file:
            file.seek(offset)
            assert int.from_bytes(file.read(8), "little") == 3
        resumed = training_order.read_training_order(spark, layout, 130).collect()
        assert sorted(r["slot"] for r in resumed) == list(range(130, layout.sequences))
        assert {r["slot"]: r["ids"] for r in resumed}.items() <= {r["slot"]: r["ids"] for r in records}.items()
        assert not [f for f in os.listdir(tmp_path / f"order{k}") if not f.startswith("shard-")]
    layout, manifest = training_order.write_training_order(empty, str(tmp_path / "none"))
    assert layout.sequences == 0 and training_order.read_training_order(spark, layout).count() == 0


def test_training_order_does_not_depend_on_partitions(spark, documents, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(training_order, "FRAME_DOCS", 7)
    monkeypatch.setattr(training_order, "HELD_IDS", 5000)
    for name, df in (("documents", documents), ("odd", odd)):
        sums = []
        for parts in (1, 3, 8):
            _, manifest = training_order.write_training_order(df.repartition(parts), str(tmp_path / f"{name}{parts}"), shard_slots=16)
            sums.append(sorted(map(tuple, manifest.collect())))
        assert sums[0] == sums[1] == sums[2]


def test_training_order_query_returns_the_ids(spark, tiny, documents):
    records = sorted(llm.op1_training_order(spark, tiny).collect(), key=lambda r: r["number"])
    assert all(len(r["ids"]) == r["length"] and r["ids"].count(training_order.CLOSE) == r["n_closed"] for r in records)
    want = Counter(tuple(tokens.fast().encode_ordinary(r["text"] or "")) for r in documents.collect())
    got, text = Counter(), []
    for i in (i for r in records for i in r["ids"]):
        if i == training_order.CLOSE:
            got[tuple(text)] += 1
            text = []
        else:
            text.append(i)
    assert not text and got == want


# --- pipeline


def test_pipeline_matches_brute_force(spark, tiny, documents):
    docs = {r["doc_id"]: r for r in documents.collect()}
    order = sorted(docs)
    bits = ledger.failures(ledger.measure([docs[i]["text"].encode() for i in order]))
    alive = [i for i, b in zip(order, bits) if b & ledger.PRODUCTION.mask == 0]
    model = langid.fit(documents.filter(documents.doc_id.isin(alive)))
    labels, scores = langid.predict([docs[i]["text"].encode() for i in alive], model)
    alive = [i for i, x, s in zip(alive, labels, scores) if x != "und" and s >= 0.5]
    seen, unique = set(), []
    for i in alive:
        key = b" ".join((b"x" + docs[i]["text"].encode() + b"x").split())
        if key not in seen:
            seen.add(key)
            unique.append(i)
    classes = slow_classes([docs[i]["text"] for i in unique])
    alive = [i for k, i in enumerate(unique) if classes[k] == k]
    got = corpus_pipeline.run(spark, tiny).collect()
    check_packing(got, [docs[i] for i in alive])


def test_stages_keep_columns_and_odd_rows(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (odd.select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars")):
            assert stage(spark, df, "").columns == ["doc_id", "text", "lang", "source", "n_chars"]
            stage(spark, df, "").count()


def test_every_query_has_a_name_and_sql_has_a_query():
    assert set(llm.oracle_sql()) <= set(llm.queries()) and len([q for q in llm.queries() if q.startswith("op")]) >= 10
