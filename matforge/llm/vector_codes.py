"""Vector codes: a codebook per part of the vector, fitted over anchors-hierarchy metric trees.

Vectors are cut into equal parts. The parts of a block of vectors at one position form a metric tree,
built middle-out: anchors claim the points nearest to them, each new one at the farthest point of the widest anchor,
and are then merged pairwise upwards; below, each is divided by anchors of its own. Every ball caches the number and the sum
of its points. A round of fitting walks down the trees with a list of candidate entries that each ball inherits
from its parent: an entry that is farther from the whole ball than another is struck out, and a
ball with one entry left is added to it by its cached sum, its points unseen. Only leaves with several candidates
left look at their points, in whole numbers.

Trees are built once per block, written to the shared folder and walked once per round, so a lost executor costs single
blocks. A round's sums (parts x entries x components numbers per task) are added up by Spark; the codebooks
(parts x entries x components numbers) are the only thing on the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.llm.words import stretches
from matforge.runtime import materialise

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components become floor(SCALE * x).
SCALE = 256
#: Scaled components beyond this would overflow the sums of squares.
LARGEST = 1 << 26
#: Vectors per block: bounds a task's memory, and has no effect on codes.
BLOCK = 16384
#: An anchor is divided into leaves of about this many points.
LEAF = 8
#: Numbers in one array of distances.
STEP = 1 << 22
#: At most this many labels' sums are broadcast; more are joined by shuffling.
BROADCAST_LABELS = 100_000
#: Relative slack of distances between real numbers, far above their rounding.
SLACK = 1e-9

#: What a tree consists of: the points in leaf order and their places in the block, then per ball its radius, sum, parent (-1: none),
#: depth, first point and number of points. Parents stand before their children; a ball's points follow one another.
FIELDS = {"points": np.int32, "place": np.int32, "radius": np.float64, "total": np.int64, "parent": np.int32, "depth": np.int32, "begin": np.int32, "count": np.int32}
TREES = "ids array<long>, labels array<long>, " + ", ".join(f"{name} array<binary>" for name in FIELDS)


# --- trees


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("...i,...i->...", x, x))


def _anchors(points: np.ndarray, starts: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Each point's anchor, for groups of points that begin at ``starts``: at most ``want`` anchors a group.

    All groups get a new anchor at once, each at the point farthest from its own anchor. A point can change to it only
    if it lies beyond half the distance between the old anchor and the new one, so other points are not looked at.
    """
    groups = len(starts)
    group = np.repeat(np.arange(groups), np.diff(starts, append=len(points)))
    spots, home = np.empty((int(want.sum()), points.shape[1])), np.empty(int(want.sum()), dtype=np.int64)
    spots[:groups], home[:groups], made, had = points[starts], np.arange(groups), groups, np.ones(groups, dtype=np.int64)
    owner, away = group.copy(), _lengths(points - points[starts][group])
    while True:
        peak = np.maximum.reduceat(away, starts)
        open_ = (peak > 0) & (had < want)
        if not open_.any():
            return owner
        farthest = np.flatnonzero((away == peak[group]) & open_[group])
        which, at = np.unique(group[farthest], return_index=True)
        new = np.full(groups, -1)
        new[which] = np.arange(made, made + len(which))
        spots[new[which]], home[new[which]] = points[farthest[at]], which
        to = new[home[:made]]
        half = np.where(to >= 0, _lengths(spots[:made] - spots[to]) / 2, np.inf)
        risk = np.flatnonzero(away > half[owner])
        there = _lengths(points[risk] - spots[new[group[risk]]])
        won = there < away[risk]
        owner[risk[won]], away[risk[won]] = new[group[risk[won]]], there[won]
        made, had = made + len(which), had + open_


def _merged(centre: np.ndarray, radius: np.ndarray, count: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs of balls to merge, the least enclosing pair first, and all balls' radii: merge i makes ball len(radius) + i."""
    n = len(radius)
    centre, count, radii = centre.copy(), count.astype(np.float64), np.concatenate([radius, np.zeros(n - 1)])
    apart = _lengths(centre[:, None] - centre[None]) + radius[:, None] + radius[None]
    np.fill_diagonal(apart, np.inf)
    at, pairs = np.arange(n), []
    for i in range(n - 1):
        a, b = divmod(int(apart.argmin()), n)
        middle = (centre[a] * count[a] + centre[b] * count[b]) / (count[a] + count[b])
        ends = _lengths(centre[[a, b]] - middle) + radii[at[[a, b]]]
        pairs.append((int(at[a]), int(at[b])))
        centre[a], count[a], at[a], radii[n + i] = middle, count[a] + count[b], n + i, ends.max()
        apart[b], apart[:, b] = np.inf, np.inf
        live = np.flatnonzero(apart[a] < np.inf)
        apart[a, live] = apart[live, a] = _lengths(centre[live] - middle) + radii[at[live]] + radii[n + i]
    return pairs, radii


def grow_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """The tree of some points: about the square root of their number of anchors in the middle, merged upwards and divided downwards."""
    x = points.astype(np.float64)
    owner = np.unique(_anchors(x, np.zeros(1, dtype=np.int64), np.array([max(1, math.isqrt(len(x)))])), return_inverse=True)[1]
    size = np.bincount(owner)
    by = np.argsort(owner, kind="stable")
    starts = np.cumsum(size) - size
    centre = np.add.reduceat(x[by], starts) / size[:, None]
    radius = np.maximum.reduceat(_lengths(x[by] - centre[owner[by]]), starts)
    pairs, radii = _merged(centre, radius, size)
    # balls from the root down, so that parents come first; anchors in the order in which they are met
    root, n = len(radii) - 1, len(size)
    met, parents, depths, stack, anchors = [], [], [], [(root, -1, 0)], []
    while stack:
        ball, parent, depth = stack.pop()
        parents.append(parent)
        depths.append(depth)
        if ball < n:
            anchors.append((ball, len(met)))
        else:
            stack += [(child, len(met), depth + 1) for child in pairs[ball - n]]
        met.append(ball)
    order, above = np.array(anchors).T
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    by = np.argsort(rank[owner], kind="stable")
    size = size[order]
    starts = np.cumsum(size) - size
    leaf = _anchors(x[by], starts, np.minimum(-(-size // LEAF), max(1, math.isqrt(len(x)))))
    inner = np.lexsort((leaf, np.repeat(np.arange(n), size)))
    by, leaf = by[inner], leaf[inner]
    first = np.flatnonzero(np.diff(leaf, prepend=-1))
    count = np.diff(first, append=len(x))
    x = x[by]
    under = above[np.repeat(np.arange(n), size)[first]]
    parent = np.concatenate([parents, under]).astype(np.int64)
    begin, end = np.full(len(parent), len(x)), np.zeros(len(parent), dtype=np.int64)
    begin[len(met) :], end[len(met) :] = first, first + count
    for i in range(len(parent) - 1, 0, -1):
        begin[parent[i]], end[parent[i]] = min(begin[parent[i]], begin[i]), max(end[parent[i]], end[i])
    sums = np.concatenate([np.zeros((1, x.shape[1]), dtype=np.int64), np.cumsum(x.astype(np.int64), axis=0)])
    own = np.repeat(np.arange(len(first)), count)
    mean = np.add.reduceat(x, first) / count[:, None]
    leaf_radius = np.maximum.reduceat(_lengths(x - mean[own]), first)
    depth = np.array(depths)
    return {
        "points": x, "place": by, "radius": np.concatenate([radii[met], leaf_radius]), "total": sums[end] - sums[begin],
        "parent": parent, "depth": np.concatenate([depth, depth[under] + 1]), "begin": begin, "count": end - begin,
    }


def _packed(tree: dict[str, np.ndarray]) -> dict[str, bytes]:
    return {name: tree[name].astype(kind).tobytes() for name, kind in FIELDS.items()}


def _unpacked(batch: pa.RecordBatch, row: int, part: int) -> dict[str, np.ndarray]:
    """One tree of a written row."""
    tree = {name: np.frombuffer(batch.column(name)[row].values[part].as_py(), kind) for name, kind in FIELDS.items()}
    width = len(tree["total"]) // len(tree["radius"])
    return tree | {name: tree[name].reshape(-1, width) for name in ("points", "total")}


def _walk(tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Balls that one entry owns wholly, with that entry; and leaves with several entries left, with their lists.

    Goes down by depth. A ball inherits its parent's list and strikes out each entry whose nearest possible point is
    farther than the farthest possible point of the ball is from the list's nearest entry.
    """
    parent, depth = tree["parent"], tree["depth"]
    centre, radius = tree["total"] / tree["count"][:, None], tree["radius"] * (1 + SLACK)
    ends = np.ones(len(parent), dtype=bool)
    ends[parent[1:]] = False
    owned, owner, leaves, lists = [], [], [], []
    lots = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[lots], np.arange(depth.max() + 2))
    left = np.zeros((len(parent), len(entries)), dtype=bool)
    going = np.zeros(len(parent), dtype=bool)
    for level in range(len(bounds) - 1):
        balls = lots[bounds[level] : bounds[level + 1]]
        if level:
            balls = balls[going[parent[balls]]]
        if not len(balls):
            break
        listed = left[parent[balls]] if level else np.ones((1, len(entries)), dtype=bool)
        away = np.where(listed, _lengths(centre[balls][:, None] - entries[None]), np.inf)
        limit = away.min(1) * (1 + SLACK) + radius[balls]
        listed &= away * (1 - SLACK) <= (limit + radius[balls])[:, None]
        single, end = listed.sum(1) == 1, ends[balls]
        owned.append(balls[single])
        owner.append(listed[single].argmax(1))
        leaves.append(balls[end & ~single])
        lists.append(listed[end & ~single])
        left[balls], going[balls] = listed, ~single & ~end
    return np.concatenate(owned), np.concatenate(owner), np.concatenate(leaves), np.concatenate(lists)


def _nearest(tree: dict[str, np.ndarray], entries: np.ndarray, leaves: np.ndarray, lists: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points, their nearest entries) of the leaves, looking at listed entries alone, in whole numbers; the first of equals."""
    leaf, listed = np.nonzero(lists)
    first = np.searchsorted(leaf, np.arange(len(leaves) + 1))
    work = np.cumsum(tree["count"][leaves] * np.diff(first)) * entries.shape[1] // STEP
    for lot in np.unique(work):
        mine = np.flatnonzero(work == lot)
        points = stretches(tree["begin"][leaves[mine]], tree["count"][leaves[mine]])
        of = np.repeat(mine, tree["count"][leaves[mine]])
        options = first[of + 1] - first[of]
        tried = listed[stretches(first[of], options)]
        gap = np.repeat(tree["points"][points], options, axis=0) - entries[tried]
        away = np.einsum("ij,ij->i", gap, gap)
        at = np.cumsum(options) - options
        best = np.repeat(np.minimum.reduceat(away, at), options)
        hit = np.flatnonzero(away == best)
        yield points, tried[hit[np.searchsorted(hit, at)]]


def _add(tree: dict[str, np.ndarray], entries: np.ndarray, totals: np.ndarray, counts: np.ndarray) -> None:
    """Add a tree's points to the sums of the entries that own them: whole balls by their cached sums."""
    owned, owner, leaves, lists = _walk(tree, entries)
    np.add.at(totals, owner, tree["total"][owned])
    np.add.at(counts, owner, tree["count"][owned])
    for points, near in _nearest(tree, entries, leaves, lists):
        np.add.at(totals, near, tree["points"][points])
        np.add.at(counts, near, 1)


def _assign(tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's entry and squared distance to it, in the block's order."""
    owned, owner, leaves, lists = _walk(tree, entries)
    chosen = np.empty(len(tree["points"]), dtype=np.int64)
    chosen[stretches(tree["begin"][owned], tree["count"][owned])] = np.repeat(owner, tree["count"][owned])
    for points, near in _nearest(tree, entries, leaves, lists):
        chosen[points] = near
    gap = tree["points"] - entries[chosen]
    codes, errors = np.empty_like(chosen), np.empty_like(chosen)
    codes[tree["place"]], errors[tree["place"]] = chosen, np.einsum("ij,ij->i", gap, gap)
    return codes, errors


# --- on Spark


def scaled_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """The rows that are coded, as (vec_id, label, x): whole-number components of one length."""
    whole = F.transform(vector_col, lambda v: F.when(F.abs(v) <= float(LARGEST // SCALE), F.floor(v.cast("double") * SCALE)).cast("int"))
    kept = df.filter(F.col(vector_col).isNotNull() & F.forall(whole, lambda v: v.isNotNull())).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole.alias("x"))
    lengths = kept.groupBy(F.size("x").alias("length")).count().filter((F.col("length") > 0) & (F.col("length") % parts == 0))
    common = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    return kept.filter(F.size("x") == (common["length"] if common else -1))


def first_entries(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The starting codebooks, parts x entries x components: the parts of the vectors with the smallest ids."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()  # at most ``entries`` rows
    return np.array([r["x"] for r in rows], dtype=np.int64).reshape(len(rows), parts, len(rows[0]["x"]) // parts if rows else 0).transpose(1, 0, 2)


def build_trees(kept: DataFrame, parts: int) -> DataFrame:
    """A written row per block of vectors: their ids and labels, and a tree for each part."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), *((name, pa.list_(pa.binary())) for name in FIELDS)])

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        x = block.column("x").flatten().to_numpy().reshape(block.num_rows, parts, -1)
        trees = [_packed(grow_tree(x[:, part])) for part in range(parts)]
        one = {"ids": block.column("vec_id").to_pylist(), "labels": block.column("label").to_pylist()}
        return pa.RecordBatch.from_pylist([one | {name: [t[name] for t in trees] for name in FIELDS}], schema=schema)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, BLOCK - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == BLOCK:
                    yield row(held)
                    held, n = [], 0
        if n:
            yield row(held)

    return materialise(kept.mapInArrow(grow, TREES), "trees")


def refit(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; entries without parts stay."""
    parts, entries, width = books.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for part in range(parts):
                    _add(_unpacked(batch, row, part), books[part], totals[part], counts[part])
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(slots, width)), pa.array(np.tile(np.arange(width), len(slots))), pa.array(totals.reshape(-1, width)[slots].ravel()), pa.array(np.repeat(counts.ravel()[slots], width))], ["slot", "pos", "total", "n"])

    sums = trees.mapInArrow(add_up, "slot long, pos long, total long, n long").groupBy("slot", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    fresh = books.copy().reshape(-1, width)
    for r in sums.collect():  # at most parts x entries x components rows
        fresh[r["slot"], r["pos"]] = r["total"] // r["n"]
    return fresh.reshape(books.shape)


def encode(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    parts = books.shape[0]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes, errors = zip(*(_assign(_unpacked(batch, row, part), books[part]) for part in range(parts)))
                digits = np.array(codes, dtype=np.uint8).T.tobytes().hex()
                texts = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values, batch.column("labels")[row].values, pa.array(texts, pa.string()), pa.array(np.sum(errors, axis=0))], ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(look_up, "vec_id long, label long, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the errors summed over equal labels. Labels are summed before they are joined; a few are broadcast, many are dealt
    out with a salt, so that a label which holds many rows does not fill one task."""
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label"), "labels")
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
    salts = 16
    dealt = coded.withColumn("__salt", F.pmod(F.hash("vec_id"), F.lit(salts)))
    copies = sums.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("__copy"))).drop("__label", "__salt", "__copy")


def code_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """A code per vector: two hex digits a part, the vector's error, its label's, and the digest of the codebooks.

    Null vectors and those with a null or non-finite component are left out, as are components of more than 2^18 in magnitude, whose
    squares would overflow, and vectors whose length is not the most common one that ``parts`` divides (the longer of
    two equally common). Null labels count as one label. Rows that repeat an id are coded each; of rows that tie in
    the choice of the first entries those with lesser components come first, and null ids come last. With
    fewer vectors than ``entries`` the codebooks are as short. Other columns do not matter. An empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits tell at most 256 entries apart")
    kept = materialise(scaled_vectors(df, id_col, vector_col, label_col, parts), "vectors")
    books = first_entries(kept, parts, entries)
    if not books.size:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    trees = build_trees(kept, parts)
    for _ in range(rounds):
        books = refit(trees, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = with_label_errors(materialise(encode(trees, books), "codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
