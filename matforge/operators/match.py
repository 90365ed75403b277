"""Best match of each material against the earlier ones of its block, as joins over distinct texts.

What two materials are to each other depends on their descriptions alone, so pairs are decided once per
pair of distinct texts, however often item lists repeat them; a row then takes the best of its text's partners
that appeared before it. Per block, the first complete row of each code is its representative; complete rows with
a later place and the same code are its duplicates by an equi-join. Representatives meet earlier ones with the
same dimensions on an equi-join; whatever involves an incomplete text goes through :func:`candidates`, a
set-similarity join without loss. The one case that depends on the order of the rows is played again by ``replay``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.functions import text as T
from matforge.functions.dialect import SPARK
from matforge.operators.decide import BEST_OF, GRAVITY, NO_MATCH, REASONS, STRENGTH, decisions, filled, similarity
from matforge.operators.extract import ATTRIBUTES
from matforge.operators.pointers import roots
from matforge.runtime import materialise

#: Columns of a text that the decision reads.
COMPARED = ("raw_description", "block", "subtype", "complete", "dim_key", "nmc_code", "corrosion", "ctoks", "gram_set", "gram_more", "gram_norm", *(f"a_{a}" for a in ATTRIBUTES))
#: Columns of a text that only pairs of texts are compared by: far wider than all others, so they stay in a table of texts.
MEASURED = ("ctoks", "grams", "gram_set", "gram_more", "gram_norm", "u", "toks", "pad", "vetoed", "token_key")
#: What a mapping keeps of a material.
CARRIED = ("ord", "cpse_id", "own_code", "raw_description", "uom", "quantity", "unit_price", "block", "subtype", "category", "canonical", "complete", "dim_key")
#: What a decision on a pair says.
DECIDED = ("rule_no", "verdict", "confidence", "stage", "safety_risk", "needs_review", "reason")
#: A word that more texts of a block use is looked up together with a second one.
HOT_TEXTS = 100
#: Texts of more words look up their hot words one by one.
LONG_WORDS = 64
#: Similarity needs half the Jaccard plus half the cosine above 0.6, so their sum above this (less rounding).
BOTH = "1.2 - 1e-9"
#: Texts in a chunk of vectors, on average.
CHUNK = 1024
#: Decides pairs: SQL over a relation of structs a and b, giving the columns of :func:`decide.decisions`.
Decide = Callable[[str], str]


def _view(df: DataFrame) -> str:
    name = f"v_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


def told(texts: DataFrame) -> DataFrame:
    """Coded texts as their materials carry them: without what only pairs of texts are compared by."""
    return texts.drop(*MEASURED, *(f"r_{a}" for a in ATTRIBUTES))


def texts_of(rows: DataFrame) -> DataFrame:
    """The compared columns of each text, from its first row. Only places are grouped, and no wide row is sorted or buffered."""
    spark, m = rows.sparkSession, _view(rows)
    return spark.sql(f"SELECT /*+ SHUFFLE_HASH(f) */ {', '.join(COMPARED)} FROM {m} m LEFT SEMI JOIN (SELECT min(ord) AS low FROM {m} GROUP BY raw_description) f ON m.ord = f.low")


def pool_texts(rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per text that is compared: the compared columns, and the places of its first and last row.

    Of complete texts representatives take part with their place. Other wordings of a code only ask (``echo``), with the place of
    their representative, whether there were candidates before it. ``texts`` has the compared columns of each text once; if it is
    not at hand, they are taken from the rows.
    """
    spark, m, t = rows.sparkSession, _view(rows), _view(texts_of(rows) if texts is None else texts)
    spans = f"SELECT raw_description, min(ord) AS low, max(ord) AS high FROM {m} GROUP BY raw_description"
    reps = f"SELECT nmc_code, min(ord) AS rep FROM {m} WHERE complete GROUP BY nmc_code"
    compared = ", ".join(f"t.{c}" for c in COMPARED)
    placed = f"SELECT {compared}, coalesce(rep, low) AS first_ord, coalesce(rep, high) AS last_ord, t.complete AND low <> rep AS echo FROM {t} t JOIN ({spans}) x ON t.raw_description = x.raw_description LEFT JOIN ({reps}) r ON t.complete AND t.nmc_code = r.nmc_code"
    return materialise(spark.sql(f"SELECT *, monotonically_increasing_id() AS tid FROM ({placed}) p"), "pool")


def candidates(pool: DataFrame) -> DataFrame:
    """(x, y) of texts, not both complete, that may be similar: no similar pair is missed, few others are met.

    The texts' words are ordered by rarity within the block. Of two texts with n and m words that share o of them, Jaccard is
    o / (n + m - o). The trigram cosine is bounded by what is left of both norms without trigrams that the other text lacks, which at
    least those are whose bits in a map of 256 it has not set. Both together must pass 1.2, so Jaccard must pass 0.2 and o is more than (n + m) / 6.

    If the rarest shared word is not hot, the pair meets on it. Otherwise all shared words are hot, and the pair meets
    on the two rarest ones (unless one shared word suffices, n + m < 6, or one of the texts is long: then on one). At the
    place of a meeting no more words can be shared than those met and the ones behind them; pairs that this
    rules out are never formed. What is left is deduplicated and measured exactly on words, digits and trigrams, before any row is widened.
    """
    spark, p = pool.sparkSession, _view(pool)
    words = _view(materialise(spark.sql(f"SELECT tid, block, explode(ctoks) AS word FROM {p} WHERE NOT echo"), "words"))
    uses = f"SELECT block, word, count(*) AS uses FROM {words} GROUP BY block, word"
    ordered = f"SELECT tid, array_sort(collect_list(struct(uses, w.word AS word))) AS seq FROM {words} w JOIN ({uses}) u ON w.block = u.block AND w.word = u.word GROUP BY tid"
    bits = ", ".join(f"aggregate(filter(marks, h -> h div 64 = {k}), 0L, (acc, h) -> acc | shiftleft(1L, h % 64)) AS b{k}" for k in range(4))
    narrow = f"""SELECT t.tid, block, complete, first_ord, last_ord, size(seq) AS n, size(gram_set) AS d, gram_norm AS norm, {bits}, seq,
  size(filter(seq, x -> x.uses <= {HOT_TEXTS})) AS cold, size(seq) - floor(size(seq) / 5) AS prefix FROM (SELECT *, transform(gram_set, g -> CAST(pmod(xxhash64(g), 256) AS INT)) AS marks FROM {p}) t JOIN ({ordered}) o ON t.tid = o.tid"""
    o = _view(materialise(spark.sql(narrow), "ordered"))
    told = "tid, block, complete, first_ord, last_ord, n, d, norm, b0, b1, b2, b3"
    single = lambda keep: f"SELECT {told}, e.word AS key, at FROM (SELECT *, posexplode(seq) AS (at, e) FROM {o}) s WHERE at < prefix AND {keep}"
    hot = f"SELECT {told}, seq, greatest(1, cold) AS low, least(n, n - greatest(floor(n / 5) + 1, 2) + 2) - 1 AS high FROM {o} WHERE n <= {LONG_WORDS}"
    pair = f"""SELECT {told}, concat(get(seq, i).word, ' ', get(seq, at).word) AS key, at FROM (SELECT *, explode(sequence(low - 1, at - 1)) AS i FROM (
  SELECT *, explode(sequence(low, high)) AS at FROM ({hot}) h WHERE low <= high) h1) h2 WHERE get(seq, i).uses > {HOT_TEXTS}"""
    made = {name: _view(materialise(spark.sql(q), name)) for name, q in (("cold", single(f"e.uses BETWEEN 2 AND {HOT_TEXTS}")), ("hot", pair), ("few", single(f"e.uses > {HOT_TEXTS} AND n <= 4")), ("wide", single(f"e.uses > {HOT_TEXTS} AND n > {LONG_WORDS // 5}")))}
    lacks = lambda x, y: f"greatest({x}.d - {y}.d, {' + '.join(f'bit_count({x}.b{k} & ~{y}.b{k})' for k in range(4))})"
    cosine = f"sqrt((x.norm - {lacks('x', 'y')}) / x.norm * ((y.norm - {lacks('y', 'x')}) / y.norm))"

    def meet(x: str, y: str, met: int, more: str) -> str:
        most = f"({met} + least(x.n - x.at, y.n - y.at) - 1)"
        return f"""SELECT x.tid AS x, y.tid AS y FROM {x} x JOIN {y} y ON x.block = y.block AND x.key = y.key AND y.first_ord < x.last_ord AND NOT (x.complete AND y.complete)
  AND 6 * {most} > x.n + y.n AND {most} / (x.n + y.n - {most}) + {cosine} > {BOTH} AND {more}"""

    long = f"(SELECT * FROM {made['wide']} WHERE n > {LONG_WORDS})"
    parts = [meet(made["cold"], made["cold"], 1, "true"), meet(made["hot"], made["hot"], 2, "x.n + y.n > 5"), meet(made["few"], made["few"], 1, "x.n + y.n < 6"), meet(long, made["wide"], 1, "true"), meet(made["wide"], long, 1, "true")]
    # a text that is repeated meets itself even if it shares no word with another one
    parts.append(f"SELECT tid, tid FROM {p} WHERE NOT complete AND first_ord < last_ord")
    met = _view(materialise(spark.sql(f"SELECT DISTINCT x, y FROM ({' UNION ALL '.join(parts)}) m"), "met"))
    told = f"(SELECT tid, ctoks, gram_set, gram_more, gram_norm FROM {p})"
    measured = f"SELECT m.x, m.y FROM {met} m JOIN {told} x ON m.x = x.tid JOIN {told} y ON m.y = y.tid WHERE NOT {T.numeric_mismatch(SPARK, 'x.ctoks', 'y.ctoks')} AND {similarity(SPARK, 'x', 'y')} > 0.6"
    return materialise(spark.sql(measured), "candidates")


def near_vectors(pool: DataFrame, least: float = 0.6) -> DataFrame:
    """(x, y) of texts, not both complete, whose vectors' product passes ``least``: exactly, by products of chunks.

    No bound on words holds for vectors, so every pair of a block has to be measured. Texts lie in chunks of some ``CHUNK`` and each
    pair of chunks is a task's group of two matrices; only pairs that pass leave it. The work is quadratic in a block's distinct texts.
    """
    spark, p = pool.sparkSession, _view(pool)
    told = "tid, complete, first_ord, last_ord, vector"
    texts = f"SELECT block, {told}, pmod(xxhash64(tid), chunks) AS chunk, chunks FROM (SELECT * FROM {p} WHERE vector IS NOT NULL AND NOT echo) t JOIN (SELECT block AS b, CAST(ceil(count(*) / {CHUNK}) AS INT) AS chunks FROM {p} WHERE vector IS NOT NULL AND NOT echo GROUP BY block) n ON block = b"
    chunks = _view(materialise(spark.sql(f"SELECT block, chunk, chunks, collect_list(struct({told})) AS held FROM ({texts}) x GROUP BY block, chunk, chunks"), "chunks"))
    cells = spark.sql(f"SELECT block, least(chunk, other) AS low, greatest(chunk, other) AS high, chunk, held FROM (SELECT *, explode(sequence(0, chunks - 1)) AS other FROM {chunks}) c")

    def products(group: pa.Table) -> pa.Table:
        sides = []
        for held in group.column("held").to_pylist():
            sides.append((np.array([h["vector"] for h in held], dtype=np.float64), *(np.array([h[k] for h in held]) for k in ("tid", "complete", "first_ord", "last_ord"))))
        made: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2]
        if len(sides) == 1 and group.column("low")[0] != group.column("high")[0]:
            sides = []  # the other chunk has no texts
        for a, b in () if not sides else ((sides[0], sides[-1]), (sides[-1], sides[0]))[: len(sides)]:
            hit = (a[0] @ b[0].T > least - 1e-9) & ~(a[2][:, None] & b[2]) & (b[3] < a[4][:, None])
            x, y = np.nonzero(hit)
            made.append((a[1][x], b[1][y]))
        return pa.table({"x": np.concatenate([m[0] for m in made]).astype(np.int64), "y": np.concatenate([m[1] for m in made]).astype(np.int64)})

    return materialise(cells.groupBy("block", "low", "high").applyInArrow(products, "x long, y long"), "near")


def decided_pairs(pool: DataFrame, decide: Decide | None = None) -> DataFrame:
    """Pairs of texts that are not distinct: a_text and b_text, the decision, and the place of b's first row."""
    spark, p = pool.sparkSession, _view(pool)
    vectors = "vector" in pool.columns
    decide = decide or (lambda pairs: decisions(SPARK, pairs, vectors))
    same_size = f"SELECT x.tid AS x, y.tid AS y FROM {p} x JOIN {p} y ON x.block = y.block AND x.dim_key = y.dim_key AND y.first_ord < x.last_ord WHERE x.complete AND y.complete AND NOT y.echo"
    open_ = candidates(pool)
    if vectors:
        open_ = open_.unionByName(near_vectors(pool)).distinct()
    met = _view(materialise(spark.sql(f"{same_size} UNION ALL SELECT x, y FROM {_view(open_)}"), "met"))
    pairs = f"(SELECT struct(a.*) AS a, struct(b.*) AS b FROM {met} t JOIN {p} a ON a.tid = t.x JOIN {p} b ON b.tid = t.y) pairs"
    out = f"""
SELECT a.raw_description AS a_text, a.complete AS a_complete, b.raw_description AS b_text, b.first_ord AS matched_ord, b.complete AS matched_complete, {', '.join(DECIDED)}
FROM ({decide(pairs)}) d WHERE verdict <> 'distinct'"""
    return materialise(spark.sql(out), "decided")


def comparable(rows: str, pool: str, decided: str) -> str:
    """SQL: (ord, n), how many candidates before a row are not distinct from it, for incomplete rows and representatives.

    Per text, the places of its partners' rows and of its own are put in order and counted up, first within stretches of places, then
    over the stretches, so a text that holds very many rows is no single task.
    """
    heard = f"""SELECT a_text, matched_ord AS ord, 1 AS w FROM {decided} WHERE matched_complete
UNION ALL SELECT /*+ SHUFFLE_HASH(d) */ d.a_text, m.ord, 1 FROM {decided} d JOIN {rows} m ON NOT d.matched_complete AND NOT m.complete AND d.b_text = m.raw_description
UNION ALL SELECT raw_description, ord, 0 FROM {rows} WHERE NOT complete UNION ALL SELECT raw_description, first_ord, 0 FROM {pool} WHERE complete AND NOT echo"""
    within = f"SELECT *, ord div 65536 AS stretch, sum(w) OVER (PARTITION BY a_text, ord div 65536 ORDER BY ord, w ROWS UNBOUNDED PRECEDING) AS upto FROM ({heard}) h"
    before = f"SELECT a_text, stretch, sum(n) OVER (PARTITION BY a_text ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT a_text, ord div 65536 AS stretch, sum(w) AS n FROM ({heard}) h GROUP BY 1, 2) g"
    return f"SELECT i.ord, i.upto + coalesce(b.before, 0) AS n FROM ({within}) i JOIN ({before}) b ON i.a_text = b.a_text AND i.stretch = b.stretch WHERE i.w = 0"


def linked(rows: DataFrame, pool: DataFrame, decided: DataFrame) -> DataFrame:
    """Each material with its best match, the decision on it, and the number of candidates that were not distinct.

    Tables of rows are joined by merging, and rows with their texts' partners by hashing the partners: rows that repeat their texts lie in few
    bytes on disk, so Spark would take a table of millions for a small one and send it whole to every executor.
    """
    spark, m, p, d = rows.sparkSession, _view(rows), _view(pool), _view(decided)
    order = f"{STRENGTH} DESC, confidence DESC, {GRAVITY}, CASE WHEN matched_complete THEN 0 ELSE 1 END, matched_ord"
    # of a text's partners in order of merit only those that came before all better ones can ever be a row's best
    front = f"""SELECT * FROM (SELECT *, min(matched_ord) OVER (PARTITION BY a_text ORDER BY merit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT *, row_number() OVER (PARTITION BY a_text ORDER BY {order}) AS merit FROM {d}) r) f WHERE before IS NULL OR matched_ord < before"""
    asking = f"SELECT m.ord, m.raw_description FROM {m} m WHERE NOT complete UNION ALL SELECT first_ord, raw_description FROM {p} WHERE complete AND NOT echo"
    best = f"""SELECT /*+ SHUFFLE_HASH(f) */ ord, min_by(struct(matched_ord, {', '.join(DECIDED)}), merit) AS b
FROM ({asking}) q JOIN ({front}) f ON q.raw_description = f.a_text AND f.matched_ord < q.ord GROUP BY ord"""
    # a copy stops at its representative, having met those of the same dimensions before it
    passed = f"SELECT a_text, count(*) AS n FROM {d} WHERE a_complete AND matched_complete GROUP BY a_text"
    out = f"""
SELECT /*+ MERGE(e, k) */ {', '.join(f'r.{c}' for c in CARRIED)}, r.nmc_code AS own_nmc, copy,
  CASE WHEN copy THEN p.first_ord ELSE b.matched_ord END AS matched_ord, CASE WHEN copy THEN 1 ELSE b.rule_no END AS rule_no,
  CASE WHEN copy THEN 'duplicate' ELSE coalesce(b.verdict, 'distinct') END AS verdict, CASE WHEN copy THEN 1.0D ELSE coalesce(b.confidence, 1.0D) END AS confidence,
  CASE WHEN copy THEN 'rule' ELSE coalesce(b.stage, 'rule') END AS stage, CASE WHEN copy THEN 'LOW' ELSE b.safety_risk END AS safety_risk,
  CASE WHEN copy THEN false ELSE coalesce(b.needs_review, false) END AS needs_review,
  CASE WHEN copy THEN '{REASONS[0]}' ELSE coalesce(b.reason, '{NO_MATCH}') END AS first_reason,
  CASE WHEN copy THEN 1 + coalesce(h.n, 0) ELSE coalesce(k.n, 0) END AS n_comparable
FROM (SELECT {', '.join(CARRIED)}, nmc_code FROM {m}) r
LEFT JOIN (SELECT nmc_code, first_ord FROM {p} WHERE complete AND NOT echo) p ON r.complete AND r.nmc_code = p.nmc_code
LEFT JOIN ({best}) e ON r.ord = e.ord
LEFT JOIN ({comparable(m, p, d)}) k ON r.ord = k.ord
LEFT JOIN ({passed}) h ON r.complete AND r.raw_description = h.a_text
CROSS JOIN LATERAL (SELECT r.complete AND r.ord <> p.first_ord AS copy) c"""
    return materialise(spark.sql(out), "linked")


#: The reason in full: that of the decision, and how many candidates it was the best of.
REASON = f"CASE WHEN n_comparable > 1 THEN concat(first_reason, ' | ', {filled(BEST_OF, {'n': 'CAST(n_comparable AS STRING)'})}) ELSE first_reason END"
STATUS = "CASE WHEN needs_review THEN 'pending-review' ELSE 'auto-issued' END"


def planned_texts(rows: DataFrame) -> DataFrame:
    """(raw_description): the texts that a comparison of wordings may need, each once.

    Those of incomplete items in blocks of several rows, and of complete items that share their dimensions with another code.
    """
    spark, m = rows.sparkSession, _view(rows)
    crowded = f"SELECT block FROM {m} GROUP BY block HAVING count(*) > 1"
    split = f"SELECT block, dim_key FROM {m} WHERE complete GROUP BY block, dim_key HAVING count(DISTINCT nmc_code) > 1"
    return spark.sql(f"""SELECT DISTINCT raw_description FROM (
  SELECT raw_description FROM {m} m LEFT SEMI JOIN ({crowded}) c ON m.block = c.block WHERE NOT complete
  UNION ALL SELECT raw_description FROM {m} m LEFT SEMI JOIN ({split}) s ON m.block = s.block AND m.dim_key = s.dim_key WHERE complete) t WHERE trim(raw_description) <> ''""")


def map_materials(rows: DataFrame, decide: Decide | None = None, vectors: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """The mapping of coded materials (a written table): match, decision, code in force (its root's own code) and status of each.

    ``vectors`` (text, vector) gives texts vectors of norm 1; pairs of which both have one are compared by them, others by their words.
    ``texts`` (see ``pool_texts``) has what the texts are compared by; the rows need not carry it then.

    ``decide`` may replace the cascade, on pairs that are similar by words and trigrams. Blocks in which two representatives of the same
    dimensions ended under one incomplete item's code are played again row by row (see ``replay``), since there the second one
    is no candidate for later rows. An empty table gives an empty mapping.
    """
    spark = rows.sparkSession
    known = vectors.select(F.col("text").alias("raw_description"), "vector") if vectors is not None else None
    seen = lambda texts: texts if known is None else materialise(texts.join(known, "raw_description", "left"), "pool")
    pool = seen(pool_texts(rows, texts))
    found = linked(rows, pool, decided_pairs(pool, decide))
    name = _view(found)
    ends = _view(roots(spark.sql(f"SELECT ord, CASE WHEN verdict = 'duplicate' THEN matched_ord END AS up FROM {name}"), "ord", "up"))
    out = f"""
SELECT /*+ MERGE(r, o, q, p) */ l.*, o.own_nmc AS nmc_code, p.own_nmc AS matched_nmc
FROM {name} l JOIN {ends} r ON l.ord = r.ord JOIN (SELECT ord, own_nmc FROM {name}) o ON r.root = o.ord
  LEFT JOIN {ends} q ON l.matched_ord = q.ord LEFT JOIN (SELECT ord, own_nmc FROM {name}) p ON q.root = p.ord"""
    closed = materialise(spark.sql(out), "mapping")
    c = _view(closed)
    merged = materialise(spark.sql(f"SELECT DISTINCT block FROM (SELECT block, dim_key, nmc_code FROM {c} WHERE complete AND NOT copy GROUP BY block, dim_key, nmc_code HAVING count(*) > 1) g"), "blocks")
    if not merged.isEmpty():
        wide = (texts_of(rows) if texts is None else texts).select(*COMPARED)
        again = replay(rows.join(merged, "block", "left_semi"), lambda places: decided_pairs(seen(materialise(wide.join(places, "raw_description"), "pool")), decide))
        closed = materialise(closed.join(merged, "block", "left_anti").unionByName(again.select(*closed.columns)), "mapping")
    return closed.selectExpr("* EXCEPT (copy)", f"{REASON} AS reason", f"{STATUS} AS status")


#: State of a replay and its answer: a decision as in DECIDED, codes, and whether the row is no candidate of its own.
REPLAYED = "ord long, copy boolean, matched_ord long, rule_no int, verdict string, confidence double, stage string, safety_risk string, needs_review boolean, first_reason string, n_comparable long, nmc_code string, matched_nmc string"


def replay(rows: DataFrame, decided: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The mapping's rows of some blocks, decided in order of place.

    Each row meets the candidates before it and takes the best; it becomes a candidate under the code it got, a complete row only if its
    dimensions have none under that code yet. That depends on all rows before it, so a block is one task's stream; the task holds
    one entry per distinct text of the block and one row with its partners at a time. Decisions themselves are made before, as joins:
    ``decided`` gives them for the texts' places.
    """
    spark, m = rows.sparkSession, _view(rows)
    spans = f"SELECT raw_description, min(ord) AS first_ord, max(ord) AS last_ord FROM {m} GROUP BY raw_description"
    places = materialise(spark.sql(f"SELECT *, false AS echo, monotonically_increasing_id() AS tid FROM ({spans}) x"), "places")
    d = _view(decided(places))
    merit = f"struct(-({STRENGTH}) AS rank, -confidence AS unsure, {GRAVITY} AS gravity, b_text, {', '.join(DECIDED)})"
    partners = f"SELECT a_text, collect_list({merit}) AS partners FROM {d} GROUP BY a_text"
    told = spark.sql(f"SELECT block, ord, raw_description, complete, dim_key, nmc_code, partners FROM {m} m LEFT JOIN ({partners}) p ON m.raw_description = p.a_text")
    played = told.repartition("block").sortWithinPartitions("block", "ord").mapInArrow(_play, REPLAYED)
    return rows.select(*CARRIED, F.col("nmc_code").alias("own_nmc")).join(played, "ord")


def _play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, names = None, [x.split()[0] for x in REPLAYED.split(", ")]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["block"] != block:
                block = row["block"]
                # text -> (place, code in force); own code -> (place, code in force, number among its dimensions); open text -> rows
                closed, codes, open_, counts, sizes = {}, {}, {}, {}, {}
            own, size, text = row["nmc_code"], row["dim_key"], row["raw_description"]
            partners = row["partners"] or []
            if row["complete"] and own in codes:
                place, code, earlier = codes[own]
                n = 1 + sum(p["b_text"] in closed and closed[p["b_text"]][2] < earlier for p in partners)
                best = {"rule_no": 1, "verdict": "duplicate", "confidence": 1.0, "stage": "rule", "safety_risk": "LOW", "needs_review": False, "reason": REASONS[0]}
            else:
                place = code = None
                best, n, leading = {"rule_no": None, "verdict": "distinct", "confidence": 1.0, "stage": "rule", "safety_risk": None, "needs_review": False, "reason": NO_MATCH}, 0, None
                for p in partners:
                    for kind, pool in enumerate((closed, open_)):
                        if p["b_text"] in pool:
                            found = pool[p["b_text"]]
                            n += counts[p["b_text"]] if kind else 1
                            merit = (p["rank"], p["unsure"], p["gravity"], kind, found[0])
                            if leading is None or merit < leading:
                                leading, best, place, code = merit, p, found[0], found[1]
            given = code if best["verdict"] == "duplicate" else own
            copy = row["complete"] and given in sizes.setdefault(size, {})
            if not row["complete"]:
                open_.setdefault(text, (row["ord"], given))
                counts[text] = counts.get(text, 0) + 1
            elif not copy:
                number = len(sizes[size])
                sizes[size][given] = row["ord"]
                closed[text], codes[own] = (row["ord"], given, number), (row["ord"], given, number)
            out.append((row["ord"], copy, place, *(best[k] for k in DECIDED), n, given, code))
        columns = list(zip(*out)) or [()] * len(names)
        schema = pa.schema([(n, pa.int64() if k == "long" else pa.int32() if k == "int" else pa.float64() if k == "double" else pa.bool_() if k == "boolean" else pa.string()) for n, k in (x.split() for x in REPLAYED.split(", "))])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def comparisons(rows: str) -> str:
    """SQL for the number of pair decisions of a run that compares row by row, from counts per block and dimension key.

    An incomplete row meets all earlier representatives and incomplete rows; a representative the earlier ones of its
    dimensions and all earlier incomplete rows; any other complete row the representatives of its dimensions up to its own.
    Of a representative and an incomplete row one is earlier, so they meet once.
    """
    codes = f"SELECT block, dim_key, nmc_code, min(ord) AS rep_ord, count(*) AS n FROM {rows} WHERE complete GROUP BY block, dim_key, nmc_code"
    placed = f"SELECT *, row_number() OVER (PARTITION BY block, dim_key ORDER BY rep_ord) AS place FROM ({codes}) c"
    per_block = f"SELECT block, count(*) AS reps, sum(place - 1) AS among_reps, sum((n - 1) * place) AS copies FROM ({placed}) p GROUP BY block"
    open_ = f"SELECT block, count(*) AS n FROM {rows} WHERE NOT complete GROUP BY block"
    return f"""SELECT CAST(coalesce(sum(coalesce(among_reps, 0) + coalesce(copies, 0) + coalesce(i.n, 0) * (coalesce(i.n, 0) - 1) / 2 + coalesce(reps, 0) * coalesce(i.n, 0)), 0) AS BIGINT) AS comparisons
FROM ({per_block}) r FULL JOIN ({open_}) i ON r.block = i.block"""
