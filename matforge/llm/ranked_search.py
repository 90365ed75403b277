"""Ranked lexical search by pipelined term partitioning.

Items (the queries) travel in bundles; the index lies with owners of terms. A bundle brings its accumulators, the
scores so far of the documents that may still matter, to one owner after the other; each stage is a cogroup of the
bundles with that owner's postings, in which whole-number contributions are added.

The first owner has the rarest terms, the last the commonest. After each stage every item's k-th best score so far is a
floor of its final k-th best, and the terms still ahead can add no more than the sum of their weights' bounds; an accumulator
that cannot reach the floor any more is dropped, and so is a document met for the first time that could not reach
it. Nothing that could be in the result is lost: equal scores are kept to the end and settled by id.

Documents are cut into blocks as they are scanned, by their number and by their distinct terms, so that one task holds one bundle's
share of one block. Index, owners' postings and accumulators are tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matforge.llm.words import chunks, utf8
from matforge.runtime import materialise

TOP = 10
#: A posting adds less than this times its term's weight.
FULL = 1_000_000
#: Lowest weights of the terms of each owner but the last: e times rarer means 1000 more.
OWNERS = (5500, 3500, 1400)
#: Distinct terms, summed over its items, that a bundle holds, about.
BUNDLE_TERMS = 1 << 14
#: Bundles that are served by one scan of the documents: bounds the terms in memory at about BUNDLE_TERMS times this.
ROUND_BUNDLES = 32
#: Documents and postings in a block; a single document may hold more postings.
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 20

#: Letters and digits stay, A to Z in lower case; all other ASCII characters part terms.
_FOLD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256)).lower()

INDEX = "block long, doc_ids array<long>, lengths binary, terms binary, docs binary, counts binary, df_terms array<int>, df array<long>, n_docs long, n_terms long"
POSTINGS = "bundle int, block long, owner int, doc_ids array<long>, lengths binary, terms binary, docs binary, counts binary"
ACCUMULATORS = "bundle int, block long, items binary, docs binary, scores binary, ids array<long>, top_items array<int>, top_scores array<long>"


def split_terms(text: bytes | None) -> list[bytes]:
    """The terms of a text: runs of letters, digits and anything beyond ASCII, A to Z in lower case."""
    return text.translate(_FOLD).split() if text else []


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, n): a written row per item and distinct term; rows that share an id are one item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch], "text"):
                terms = [split_terms(t) for t in utf8(part.column("text"))]
                at = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(at)), pa.array([t for ts in terms for t in ts], pa.binary())], ["item_id", "term"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(split, "item_id long, term binary").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n")), "item_terms")


class _Needs:
    """What the items of one round ask for: terms numbered from 0, items from 0, and the cells (item, term, times)."""

    def __init__(self, rows: pa.Table) -> None:
        # null ids are told apart from all others by a flag of their own
        ids = rows.column("item_id").combine_chunks()
        names = np.stack([np.asarray(ids.is_null(), dtype=np.int64), ids.fill_null(0).to_numpy()])
        names, self.item = np.unique(names, axis=1, return_inverse=True)
        self.item_ids = [None if null else int(i) for null, i in names.T]
        self.term, self.terms = pd.factorize(np.array(rows.column("term").to_pylist() + [None], dtype=object)[:-1])
        self.times = rows.column("n").to_numpy()
        self.bundle = np.zeros(len(self.item_ids), dtype=np.int64)
        self.bundle[self.item] = rows.column("bundle").to_numpy()

    def weigh(self, n_docs: int, total: int, df: np.ndarray, owners: tuple[int, ...]) -> None:
        """Fix weights and owners of the terms, and what each stage leaves ahead."""
        self.n_docs, self.total = n_docs, total
        self.weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        self.owner = np.searchsorted(-np.array(owners), -self.weight, side="left").astype(np.int64)
        #: ahead[i, s]: more than what the terms of the owners after s can add to item i
        self.ahead = np.zeros((len(self.item_ids), len(owners) + 1), dtype=np.int64)
        bound = self.times * np.maximum(self.weight[self.term], 0) * FULL
        for s in range(len(owners)):
            np.add.at(self.ahead[:, s], self.item, np.where(self.owner[self.term] > s, bound, 0))


def _index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """A written row per block of documents: ids, lengths, the postings of ``terms`` by term, and the counts that weights need."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {bytes(t): i for i, t in enumerate(terms)}
        task, made = TaskContext.get().partitionId(), 0
        ids, lengths, found, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            of = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            cells, counts = np.unique(flat * (len(found) or 1) + of, return_counts=True)
            term, doc = np.divmod(cells, len(found) or 1)
            df_terms, df = np.unique(term, return_counts=True)
            row = {"block": (task << 32) | made, "doc_ids": ids, "lengths": np.array(lengths, np.int64).tobytes(), "terms": term.astype(np.int32).tobytes(), "docs": doc.astype(np.int32).tobytes(), "counts": counts.astype(np.int32).tobytes()}
            row |= {"df_terms": df_terms.tolist(), "df": df.tolist(), "n_docs": sum(n > 0 for n in lengths), "n_terms": sum(lengths)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for part in chunks([batch], "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part.column("text"))):
                    words = split_terms(text)
                    known = np.array([i for i in map(number.get, words) if i is not None], dtype=np.int64)
                    ids.append(doc_id)
                    lengths.append(len(words))
                    found.append(known)
                    held += len(known)
                    if len(ids) == BLOCK_DOCS or held >= BLOCK_POSTINGS:
                        yield block()
                        ids, lengths, found, held, made = [], [], [], 0, made + 1
        if ids:
            yield block()

    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((name, pa.binary()) for name in ("lengths", "terms", "docs", "counts")), ("df_terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
    return materialise(docs.mapInArrow(scan, INDEX), "blocks", codec="zstd")


def _dealt(index: DataFrame, needs: _Needs) -> DataFrame:
    """The postings of each block, a written row per owner and bundle that needs any of them."""
    bundles = np.unique(needs.bundle)
    wanted = {int(b): np.isin(np.arange(len(needs.terms)), needs.term[needs.bundle[needs.item] == b]) for b in bundles}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole = {name: np.frombuffer(batch.column(name)[i].as_py(), np.int32) for name in ("terms", "docs", "counts")}
                owner = needs.owner[whole["terms"]]
                for b, mine in wanted.items():
                    rows = []
                    for s in range(needs.ahead.shape[1]):
                        here = np.flatnonzero(mine[whole["terms"]] & (owner == s))
                        rows.append({"bundle": b, "owner": s} | {name: column[here].tobytes() for name, column in whole.items()})
                    same = [batch.column(name).slice(i, 1).take(pa.array(np.zeros(len(rows), np.int64))) for name in ("block", "doc_ids", "lengths")]
                    own = [pa.array([r[name] for r in rows], kind) for name, kind in (("bundle", pa.int32()), ("owner", pa.int32()), ("terms", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()))]
                    yield pa.RecordBatch.from_arrays([own[0], same[0], own[1], same[1], same[2], *own[2:]], ["bundle", "block", "owner", "doc_ids", "lengths", "terms", "docs", "counts"])

    return materialise(index.select("block", "doc_ids", "lengths", "terms", "docs", "counts").mapInArrow(deal, POSTINGS), "postings", codec="zstd")


def _contributions(needs: _Needs, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
    m = 25 + (75 * length * needs.n_docs) // needs.total
    return needs.weight[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m))


def _stage(needs: _Needs, stage: int, floors: np.ndarray, k: int):
    """The work of one owner on one bundle's share of one block."""
    last = stage == needs.ahead.shape[1] - 1

    def serve(key: tuple, carried: pa.Table, postings: pa.Table) -> pa.Table:
        bundle, block = key[0].as_py(), key[1].as_py()
        get = lambda table, name, kind: np.frombuffer(table.column(name)[0].as_py(), kind)
        term, doc, count = (get(postings, name, np.int32).astype(np.int64) for name in ("terms", "docs", "counts"))
        lengths = get(postings, "lengths", np.int64)
        adds = _contributions(needs, term, count, lengths[doc])
        begin = np.searchsorted(term, np.arange(len(needs.terms) + 1))
        mine = np.flatnonzero((needs.bundle[needs.item] == bundle) & (needs.owner[needs.term] == stage))
        before = [get(carried, name, kind) for name, kind in (("items", np.int32), ("docs", np.int32), ("scores", np.int64))] if carried.num_rows else [np.empty(0, np.int64)] * 3
        by = np.argsort(before[0], kind="stable")
        old = {int(i): by[at : at + n] for i, at, n in zip(*np.unique(before[0][by], return_index=True, return_counts=True))}
        cells = dict(iter(pd.Series(mine).groupby(needs.item[mine])))
        out, tops = [], []
        score = np.zeros(len(lengths), dtype=np.int64)
        for item in sorted(old.keys() | cells.keys()):
            score[:] = 0
            if item in old:
                score[before[1][old[item]]] = before[2][old[item]]
            for cell in cells.get(item, ()):
                span = slice(begin[needs.term[cell]], begin[needs.term[cell] + 1])
                score[doc[span]] += needs.times[cell] * adds[span]  # a term names a document once
            # a document dropped before may come back with what this stage adds; it falls short of the floor again
            live = np.flatnonzero(score > 0)
            best = np.partition(score[live], len(live) - k)[len(live) - k :] if len(live) > k else score[live]
            floor = max(int(floors[item]), int(best.min()) if len(best) == k else 0)
            live = live[score[live] + needs.ahead[item, stage] >= floor]
            if not len(live):
                continue
            out.append((np.full(len(live), item), live, score[live]))
            tops.append((np.full(len(best), item), best))
        items, docs, scores = (np.concatenate(x) for x in zip(*out)) if out else [np.empty(0, np.int64)] * 3
        top_items, top_scores = (np.concatenate(x) for x in zip(*tops)) if tops else [np.empty(0, np.int64)] * 2
        ids = postings.column("doc_ids").chunk(0)[0].values.take(pa.array(docs)).to_pylist() if last else None
        row = {"bundle": bundle, "block": block, "items": items.astype(np.int32).tobytes(), "docs": docs.astype(np.int32).tobytes(), "scores": scores.astype(np.int64).tobytes(), "ids": ids}
        return pa.Table.from_pylist([row | {"top_items": top_items.tolist(), "top_scores": top_scores.tolist()}], schema=schema)

    schema = pa.schema([("bundle", pa.int32()), ("block", pa.int64()), *((name, pa.binary()) for name in ("items", "docs", "scores")), ("ids", pa.list_(pa.int64())), ("top_items", pa.list_(pa.int32())), ("top_scores", pa.list_(pa.int64()))])
    return serve


def _floors(spark: SparkSession, accumulators: DataFrame, needs: _Needs, k: int) -> np.ndarray:
    """Each item's k-th best score so far, 0 if it has fewer."""
    tops = accumulators.select(F.explode(F.arrays_zip("top_items", "top_scores")).alias("t")).select(F.col("t.top_items").alias("item"), F.col("t.top_scores").alias("score"))
    ranked = tops.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("rank") <= k)
    floors = np.zeros(len(needs.item_ids), dtype=np.int64)
    for r in ranked.filter(F.col("rank") == k).collect():  # a row per item of the round at most
        floors[r["item"]] = r["score"]
    return floors


def _search_round(docs: DataFrame, needs: _Needs, owners: tuple[int, ...], k: int) -> DataFrame:
    spark = docs.sparkSession
    index = _index(docs, needs.terms)
    sums = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not sums[0]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    df = np.zeros(len(needs.terms), dtype=np.int64)
    counts = index.select(F.explode(F.arrays_zip("df_terms", "df")).alias("t")).groupBy("t.df_terms").agg(F.sum("t.df").alias("df"))
    for r in counts.collect():  # a row per term of the round at most
        df[r["df_terms"]] = r["df"]
    needs.weigh(int(sums[0]), int(sums[1]), df, owners)
    postings = _dealt(index, needs)
    carried, floors = spark.createDataFrame([], ACCUMULATORS), np.zeros(len(needs.item_ids), dtype=np.int64)
    for stage in range(len(owners) + 1):
        owned = postings.filter(F.col("owner") == stage)
        served = carried.groupBy("bundle", "block").cogroup(owned.groupBy("bundle", "block")).applyInArrow(_stage(needs, stage, floors, k), ACCUMULATORS)
        carried = materialise(served, "accumulators")
        floors = _floors(spark, carried, needs, k)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items, scores = np.frombuffer(batch.column("items")[i].as_py(), np.int32), np.frombuffer(batch.column("scores")[i].as_py(), np.int64)
                ids = batch.column("ids")[i].values
                keep = np.flatnonzero(scores >= floors[items])
                yield pa.RecordBatch.from_arrays([pa.array([needs.item_ids[j] for j in items[keep]], pa.int64()), ids.take(pa.array(keep)), pa.array(scores[keep])], ["item_id", "doc_id", "score"])

    found = carried.select("items", "scores", "ids").mapInArrow(unpack, "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = TOP, owners: tuple[int, ...] = OWNERS) -> DataFrame:
    """The ``k`` highest-scoring documents of each item, ranked from 1.

    Every document and every item is looked at whole; the score is exact. Equal scores go by ascending id, null ids first. Null and
    blank texts have no terms: such items give no rows, such documents are not counted. Item rows that share an id (null
    too) are one item with the terms of all; document rows that share an id are documents of their own, and such rows with
    equal scores follow one another in any order. Other columns do not matter. If items or documents are missing there are no rows.
    """
    spark = docs.sparkSession
    wants = item_terms(items, item_id_col, item_text_col)
    n_bundles = max(1, -(-wants.count() // BUNDLE_TERMS))
    dealt = wants.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(n_bundles)).cast("int"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    answer = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for first in range(0, n_bundles, ROUND_BUNDLES):
        rows = dealt.filter(F.col("bundle").between(first, first + ROUND_BUNDLES - 1)).toArrow()  # bounded by the round
        if rows.num_rows:
            answer = answer.unionByName(_search_round(plain, _Needs(rows), owners, k))
    return answer
