"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Signatures. A text's five-word shingles are weighted by how often it holds them. Every shingle is a
Poisson process whose rate is its weight; each of its arrivals falls on a random register, and a
register keeps the shingle that came first. Two texts agree on a register with their probability
Jaccard similarity. Arrivals are drawn in order of time, from a generator seeded by the shingle, and a
shingle stops once its next arrival is later than every register's first (early termination).

Banding. ``BANDS`` bands of ``ROWS`` registers: texts that agree on a band are candidates. A pair of
similarity 0.8 meets in no band with probability (1 - 0.8^7)^40 < 1e-4, one of 0.85 with < 1e-6.
Registers of weighted shingles find pairs by their probability Jaccard similarity only, so a text that
holds a shingle more than once has a second set of bands, with all weights 1, for the Jaccard similarity of the
sets. Without repeats both sets of bands are the same, so all texts are looked up in one table.

Verification. The texts that agree on a band form a bucket, and its first text is the bucket's hub. First every text
is verified against its hubs, in blocks of one hub and some texts, so a group of copies costs one
comparison a text. Where texts of a bucket are then not joined with its hub, they are verified against all of the bucket
in pairs of blocks: all pairwise intersections of shingle sets at once, as a product of incidence matrices. So
every pair that meets in a band is verified or joined already. Two texts are linked if the Jaccard similarity of their
shingle sets, or the probability Jaccard similarity of their weighted shingles, is 0.8 or more. A task sends a
spanning set of its links only, so no group of copies is ever expanded into pairs, and nothing is capped. Classes are
the components of the links. Equal word sequences are one text throughout and joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matforge.llm.components import components, forest
from matforge.llm.numbering import running_totals
from matforge.llm.selection import staying
from matforge.llm.words import chunks, mix, utf8, word_hashes
from matforge.runtime import materialise

SHINGLE = 5
BANDS, ROWS = 40, 7
REGISTERS = BANDS * ROWS
SIMILAR = 0.8
#: Bytes of text sketched together.
STEP_BYTES = 4 << 20
#: Texts in a block that is verified against another, and against one hub.
BLOCK, STAR = 256, 64
#: Bytes of text in a block, on average, if its texts are long.
BLOCK_BYTES = 2 << 20
#: Candidates whose keys are broadcast to fetch their texts; more meet them in a shuffle.
BROADCAST_KEYS = 1_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and weight of each text's distinct shingles, ordered by text.

    A text of fewer than five words is one shingle; a text without words has none.
    """
    split = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    flat = word_hashes([w for ws in split for w in ws])
    begins = np.cumsum(sizes) - sizes
    number = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    text_of = np.repeat(np.arange(len(texts)), number)
    first = np.repeat(begins, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    end = np.repeat(begins + sizes, number)
    key = np.zeros(len(first), dtype=np.uint64)
    for k in range(SHINGLE):
        at = first + k
        word = np.where(at < end, flat[np.minimum(at, max(0, len(flat) - 1))] if len(flat) else np.uint64(0), np.uint64(0))
        key = mix(key * np.uint64(3) + word + GOLDEN)
    order = np.lexsort((key, text_of))
    key, text_of = key[order], text_of[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (text_of[1:] != text_of[:-1])
    at = np.flatnonzero(new)
    return key[at], text_of[at], np.diff(np.append(at, len(key)))


def signatures(key: np.ndarray, text_of: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers [text, register]: the shingle whose arrival there came first (0 if the text has none)."""
    times = np.full(texts * registers, np.inf)
    owner = np.zeros(texts * registers, dtype=np.uint64)
    active = np.arange(len(key))
    clock = np.zeros(len(key))
    rate = weight.astype(np.float64)
    state = mix(key ^ np.uint64(0x5851F42D4C957F2D))
    late = np.full(texts, np.inf)
    turn = 0
    while len(active):
        state[active] += GOLDEN
        draw = mix(state[active])
        clock[active] += -np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate[active]
        on = clock[active] < late[text_of[active]]
        active, draw = active[on], draw[on]
        cell = text_of[active] * registers + (mix(draw + np.uint64(turn + 1)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(times, cell, clock[active])
        first = clock[active] == times[cell]
        owner[cell[first]] = key[active[first]]
        turn += 1
        if turn % 2 == 0 or turn < 4:
            live = np.flatnonzero(np.bincount(text_of[active], minlength=texts))
            late[live] = times.reshape(texts, registers)[live].max(axis=1)
            active = active[clock[active] < late[text_of[active]]]
    return owner.reshape(texts, registers)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One key per band, [text, band]."""
    key = np.zeros((len(registers), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN
    for k in range(ROWS):
        key = mix(key * np.uint64(5) + registers[:, k::ROWS][:, :BANDS])
    return key


def text_bands(key: np.ndarray, text_of: np.ndarray, weight: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and how many each text has: none without shingles, twice ``BANDS`` with a repeated shingle."""
    bands = band_keys(signatures(key, text_of, weight, texts))
    sizes = BANDS * (np.bincount(text_of, minlength=texts) > 0)
    again = np.bincount(text_of, weights=weight - 1, minlength=texts) > 0
    own = again[text_of]
    place = np.cumsum(again) - 1
    sets = band_keys(signatures(key[own], place[text_of[own]], np.ones(int(own.sum())), int(again.sum())))
    both = np.concatenate((bands, np.zeros_like(bands)), axis=1)
    both[again, BANDS:] = sets
    sizes[again] *= 2
    return both[np.arange(2 * BANDS) < sizes[:, None]], sizes


def probability_jaccard(a: dict[int, int], b: dict[int, int]) -> float:
    """Exact probability Jaccard similarity of two weighted sets.

    For a shared element i it adds the inverse of the sum over all k of max(x_k / x_i, y_k / y_i). Ordered by y / x, the elements up to i
    count by x and those behind it by y, so two running sums give all these sums: n log n steps.
    """
    keys = sorted(a.keys() | b.keys())
    x, y = (np.array([d.get(k, 0) for k in keys], dtype=float) for d in (a, b))
    ratio = np.divide(y, x, out=np.full(len(x), np.inf), where=x > 0)
    order = np.argsort(ratio, kind="stable")
    upto_x, upto_y = np.cumsum(x[order]), np.cumsum(y[order])
    both = np.flatnonzero((x > 0) & (y > 0))
    if not len(both):
        return 0.0
    last = np.searchsorted(ratio[order], ratio[both], side="right") - 1
    return float((1.0 / (upto_x[last] / x[both] + (upto_y[-1] - upto_y[last]) / y[both])).sum())


def links(key: np.ndarray, text_of: np.ndarray, weight: np.ndarray, texts: int, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between ``rows`` and ``columns`` (text numbers)."""
    sizes = np.bincount(text_of, minlength=texts)
    code, _ = pd.factorize(key)
    shared = np.bincount(code) > 1
    use = shared[code] if len(code) else np.empty(0, bool)
    code, of = pd.factorize(code[use])[0], text_of[use]
    shape = (len(rows), len(columns))
    common, mass_r, mass_c = (np.zeros(shape, dtype=np.float32) for _ in range(3))
    place_r, place_c = np.full(texts, -1), np.full(texts, -1)
    place_r[rows], place_c[columns] = np.arange(len(rows)), np.arange(len(columns))
    heavy = np.bincount(text_of, weights=weight, minlength=texts)
    repeated = np.bincount(text_of, weights=weight - 1, minlength=texts) > 0
    share = (weight[use] / heavy[of]).astype(np.float32) if len(of) else np.empty(0, np.float32)
    order = np.argsort(code, kind="stable")
    code, of, share = code[order], of[order], share[order]
    step = 4096  # shingles per product; bounds the incidence matrices
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, (at, at + step))
        r, c, column, part = place_r[of[a:b]], place_c[of[a:b]], code[a:b] - at, share[a:b]
        left, right = np.zeros((len(rows), step), np.float32), np.zeros((len(columns), step), np.float32)
        left[r[r >= 0], column[r >= 0]] = 1
        right[c[c >= 0], column[c >= 0]] = 1
        common += left @ right.T
        if repeated.any():  # shares of a text's weight that the other text has too
            weighted = np.zeros_like(left)
            weighted[r[r >= 0], column[r >= 0]] = part[r >= 0]
            mass_r += weighted @ right.T
            weighted = np.zeros_like(right)
            weighted[c[c >= 0], column[c >= 0]] = part[c >= 0]
            mass_c += left @ weighted.T
    union = sizes[rows][:, None] + sizes[columns][None, :] - common
    similarity = common / np.maximum(union, 1)
    distinct = rows[:, None] != columns[None, :]
    i, j = np.nonzero((similarity >= SIMILAR - 1e-6) & distinct)
    exact = common[i, j].astype(np.int64) * 10 >= union[i, j].astype(np.int64) * 8
    a, b = rows[i[exact]], columns[j[exact]]
    # neither share may fall below a probability Jaccard similarity, so few pairs need the exact sum
    i, j = np.nonzero((similarity < SIMILAR) & distinct & (np.minimum(mass_r, mass_c) > SIMILAR - 1e-4))
    if len(i):
        label = np.arange(texts)
        if len(a):
            node, least = forest(a, b)
            label[node] = least
        ends = np.searchsorted(text_of, np.arange(texts + 1))
        sets = {}
        for x, y in zip(rows[i].tolist(), columns[j].tolist(), strict=True):
            if label[x] == label[y]:
                continue
            for t in (x, y):
                if t not in sets:
                    sets[t] = dict(zip(key[ends[t] : ends[t + 1]].tolist(), weight[ends[t] : ends[t + 1]].tolist(), strict=True))
            if probability_jaccard(sets[x], sets[y]) >= SIMILAR - 1e-12:
                a, b = np.append(a, x), np.append(b, y)
                label[label == label[y]] = label[x]
    return forest(a, b) if len(a) else (a, b)


def _sketch(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", STEP_BYTES):
            texts = utf8(part.column("text"))
            key, text_of, weight = shingles(texts)
            bands, sizes = text_bands(key, text_of, weight, len(texts))
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            flat = bands.view(np.int64)
            bytes_ = pa.array([len(t or b"") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), bytes_, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "digest", "bytes", "bands"])

    return docs.mapInArrow(run, "doc_id long, digest string, bytes long, bands array<long>")


def _verify(jobs: DataFrame) -> DataFrame:
    """Links between the two sides of every job; rows (job, side, node, text) come sorted by job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            nodes = np.array([h["node"] for h in held], dtype=np.int64)
            side = np.array([h["side"] for h in held])
            key, text_of, weight = shingles([h["text"].encode() for h in held])
            a, b = links(key, text_of, weight, len(held), np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["job"] != held[-1]["job"]:
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    return jobs.mapInArrow(run, "a long, b long").filter("a <> b")


def _deal(jobs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Verify jobs (job, side, node) with the nodes' texts. Jobs are numbered, so they are dealt evenly."""
    parts = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = jobs.join(texts, "node").repartitionById(parts, (F.col("job") % parts).cast("int")).sortWithinPartitions("job")
    return materialise(_verify(dealt.select("job", "side", "node", "text")), name)


def _blocks(n: str, bytes_: str, size: int) -> Column:
    return F.greatest(F.ceil(F.col(n) / size), F.ceil(F.col(bytes_) / BLOCK_BYTES), F.lit(1)).cast("long")


def _in_block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks))


def _star_links(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between texts and the hubs of their buckets."""
    stars = materialise(hits.select("hub", "node").distinct().join(texts.select("node", "bytes"), "node"), "stars")
    sizes = stars.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    numbered, _ = running_totals(sizes.select("hub", _blocks("n", "bytes", STAR).alias("blocks")), ["hub"], "blocks", "first_job")
    numbered = materialise(numbered, "star-jobs")
    members = stars.join(numbered, "hub").select((F.col("first_job") + _in_block("blocks")).alias("job"), F.lit(1).alias("side"), "node")
    job = F.explode(F.sequence(F.col("first_job"), F.col("first_job") + F.col("blocks") - 1)).alias("job")
    hubs = numbered.select(job, F.lit(0).alias("side"), F.col("hub").alias("node"))
    return _deal(members.unionByName(hubs), texts, "star-links")


def _other_links(hits: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links inside buckets with texts that are not in their hub's component."""
    own = classes.select("node", F.col("component").alias("own"))
    hub = classes.select(F.col("node").alias("hub"), F.col("component").alias("of_hub"))
    placed = hits.join(own, "node", "left").join(hub, "hub", "left").join(texts.select("node", "bytes"), "node")
    apart = F.coalesce("own", "node") != F.coalesce("of_hub", "hub")
    placed = materialise(placed.select("band", "hub", "node", "bytes", apart.alias("apart")), "placed")
    out_n, out_bytes = (F.sum(F.when(F.col("apart"), x).otherwise(0)) for x in (F.lit(1), F.col("bytes")))
    buckets = placed.groupBy("band", "hub").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), out_n.alias("u"), out_bytes.alias("u_bytes"), F.bit_xor(F.xxhash64("node")).alias("members"))
    # bands whose buckets hold the same texts are verified once
    buckets = buckets.filter("u > 0 AND n > 1").groupBy("hub", "n", "members").agg(F.min_by(F.struct("band", "bytes", "u", "u_bytes"), "band").alias("b")).select("n", "b.*")
    buckets = buckets.select("band", _blocks("u", "u_bytes", BLOCK).alias("rows"), _blocks("n", "bytes", BLOCK).alias("columns"))
    numbered, _ = running_totals(buckets.withColumn("jobs", F.col("rows") * F.col("columns")), ["band"], "jobs", "first_job")
    members = materialise(placed.select("band", "node", "apart").join(numbered, "band"), "block-jobs")
    row = members.filter("apart").withColumn("row", _in_block("rows"))
    left = row.select(F.explode(F.expr("transform(sequence(0L, columns - 1), c -> first_job + row * columns + c)")).alias("job"), F.lit(0).alias("side"), "node")
    column = members.withColumn("col", _in_block("columns"))
    right = column.select(F.explode(F.expr("transform(sequence(0L, rows - 1), r -> first_job + r * columns + col)")).alias("job"), F.lit(1).alias("side"), "node")
    return _deal(left.unionByName(right), texts, "block-links")


def _least_of_each(named: DataFrame) -> DataFrame:
    """node and the least (rep_id, digest, node) of its component.

    A component may hold a third of all texts, so its nodes are cut into shares by their hash: the least of a component
    goes to its shares (one row each), and from a share to its nodes.
    """
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = materialise(named.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int")), "named")
    shares = named.groupBy("component", "share").agg(F.min(F.struct("rep_id", "digest", "node")).alias("least"))
    shares = materialise(shares, "shares")
    whole = shares.groupBy("component").agg(F.min("least").alias("least"))
    told = shares.select("component", "share").join(whole, "component")
    return named.select("component", "share", "node").join(told, ["component", "share"]).select("node", "least")


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))


def _digest(text: Column) -> Column:
    """Names a word sequence; null if there is no word."""
    words = _words(text)
    return F.when(words != "", F.sha2(words.cast("binary"), 256))


def _candidate_texts(df: DataFrame, firsts: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text, bytes) of all texts in some bucket."""
    met = hits.select("node").unionByName(hits.select(F.col("hub").alias("node"))).distinct()
    keys = materialise(firsts.join(met, "node").select("node", "rep_id", F.xxhash64("digest").alias("check"), "bytes"), "candidates")
    texts = df.select(F.col(id_col).cast("long").alias("rep_id"), F.col(text_col).alias("text"))
    few = keys.count() <= BROADCAST_KEYS
    whole = texts.join(F.broadcast(keys) if few else keys, "rep_id")
    # not as an equality, which would become a join key and be worked out for every text
    whole = whole.filter(F.xxhash64(_digest(F.col("text"))).bitwiseXOR(F.col("check")) == 0)
    return materialise(whole.select("node", "text", "bytes"), "texts")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (the least id of its class), rep_id, kept.

    ``rep_id`` is the least id with the same word sequence. ``kept`` marks one document of each class: that of the least
    id, and where this id has several texts in the class, the text with the least digest. Rows alike in id and word
    sequence are one document, kept or dropped together; rows that share an id only are documents of their
    own, so two classes can have the same class_id. Null, empty and blank texts have no shingle and no duplicate: each
    is a class of its own. Null ids cannot be referred to: such rows are their own class (null) and kept. An
    empty table gives no rows. Other columns are not read.
    """
    return _near_duplicates(df, id_col, text_col).drop("digest")


def _near_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _digest(F.col(text_col)).alias("digest"))
    sketched = materialise(_sketch(docs), "sketches")
    able = sketched.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    firsts = able.groupBy("digest").agg(F.min(F.struct("doc_id", "bytes", "bands")).alias("f"))
    # a number of its own for each distinct text, as ids may be shared
    firsts = materialise(firsts.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("f.doc_id").alias("rep_id"), "f.bytes", "f.bands"), "firsts")
    members = materialise(able.select("doc_id", "digest").join(firsts.select("digest", "node", "rep_id"), "digest"), "members")
    bands = firsts.select("node", F.explode(F.array_distinct("bands")).alias("band"))
    hubs = materialise(bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub <> last").select("band", "hub"), "hubs")
    hits = materialise(bands.join(hubs, "band").filter("node <> hub"), "hits")
    texts = _candidate_texts(df, firsts, hits, id_col, text_col)
    found = _star_links(hits, texts)
    joined = components(found)
    more = _other_links(hits, joined, texts)
    if not more.isEmpty():
        joined = components(found.unionByName(more))
    named = joined.join(firsts.select("node", "rep_id", "digest"), "node")
    classes = _least_of_each(named).select("node", F.col("least.rep_id").alias("class_id"), F.col("least.node").alias("first"))
    classed = members.join(classes, "node", "left")
    classed = classed.select("doc_id", F.coalesce("class_id", "rep_id").alias("class_id"), "rep_id", (F.coalesce("first", "node") == F.col("node")).alias("text_stays"), "digest")
    classed = classed.select("doc_id", "class_id", "rep_id", (F.col("text_stays") & (F.col("doc_id") == F.col("class_id"))).alias("kept"), "digest")
    alone = sketched.filter("digest IS NULL OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(True).alias("kept"), "digest")
    return classed.unionByName(alone)


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with their own columns: those that :func:`near_duplicates` calls kept."""
    key = F.coalesce(_digest(F.col(text_col)), F.lit(""))
    marks = _near_duplicates(df.select(id_col, text_col), id_col, text_col)
    marks = marks.groupBy("doc_id", F.coalesce("digest", F.lit("")).alias("key")).agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    return staying(df, materialise(marks, "marks"), id_col, key, once=False)
