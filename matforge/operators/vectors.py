"""Text vectors with a written cache, and subtypes guessed from them for descriptions that no rule knows."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from matforge.functions import text as T
from matforge.functions.dialect import SPARK
from matforge.operators import dictionary as D
from matforge.operators.extract import coded
from matforge.runtime import materialise
from matforge.sources import state

#: Texts in; for each a vector of norm 1, or None where the model fails.
Embed = Callable[[list[str]], list]
#: Texts a model gets at once; least similarity for a guess.
BATCH, LEAST = 32, 0.45
SCHEMA = "key string, vector array<float>, turn long"
#: Fixed value: vectors that the cache keeps.
MOST_CACHED = 100_000


def trigram_vectors(texts: list[str], size: int = 32) -> list[list[float]]:
    """A model without weights: hashed counts of character trigrams."""
    out = []
    for text in texts:
        v, whole = np.zeros(size), f"  {text.upper()} "
        for k in range(len(whole) - 2):
            v[zlib.crc32(whole[k : k + 3].encode()) % size] += 1
        out.append((v / np.linalg.norm(v)).tolist())
    return out


def bucket_vectors(texts: list[str], size: int = 251) -> list[list[float]]:
    """A stand-in model that SQL can follow: counts of character trigrams in buckets by their code points."""
    out = []
    for text in texts:
        v, points = np.zeros(size), [ord(c) for c in f"  {text.upper()} "]
        for a, b, c in zip(points, points[1:], points[2:]):
            v[(a * 961 + b * 31 + c) % size] += 1
        out.append((v / np.sqrt((v * v).sum())).tolist())
    return out


@dataclass
class Embedded:
    """Vectors of the texts asked for, and what the call took: texts found in the cache, computed, and failed."""

    vectors: DataFrame
    hits: int
    computed: int
    failed: int


def embed_counted(texts: DataFrame, embed: Embed, cache: str, most: int = MOST_CACHED) -> Embedded:
    """(text, vector) for each distinct non-null text of the first column; the model sees each text that it can tell apart once.

    Texts go by :func:`text.cache_key`. Those in the cache table at ``cache`` are not computed again. The table keeps the ``most`` newest
    vectors, whole calls at a time and then by key, and is swapped in one step; a call itself holds all that it needs, however
    many. A failed text has a NULL vector and is tried again by a later call.
    """
    spark = texts.sparkSession
    asked = texts.select(F.col(texts.columns[0]).alias("text")).filter("text IS NOT NULL").distinct()
    asked = materialise(asked.withColumn("key", F.expr(T.cache_key(SPARK, "text"))), "texts")
    known = materialise(state.read_or_empty(spark, cache, SCHEMA), "known")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                yield pd.DataFrame({"key": part["key"].tolist(), "vector": embed(part["text"].tolist())})

    missing = asked.join(known, "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))
    fresh = materialise(missing.mapInPandas(run, "key string, vector array<float>"), "fresh")
    watched, seen = Observation(), Observation()
    asked.join(known.select("key"), "key", "left_semi").observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    fresh.observe(watched, F.count("vector").alias("computed"), F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    computed, n = watched.get["computed"], watched.get["n"]
    made = fresh.filter("vector IS NOT NULL")
    if computed:
        turn = (known.agg(F.max("turn")).first()[0] or 0) + 1
        everything = known.unionByName(made.withColumn("turn", F.lit(turn).cast("long")).select("key", "vector", "turn"))
        state.replace(everything.orderBy(F.desc("turn"), "key").limit(most), cache)
    vectors = asked.join(known.select("key", "vector").unionByName(made), "key", "left").select("text", "vector")
    return Embedded(vectors, seen.get["n"], computed, n - computed)


def embed_texts(texts: DataFrame, embed: Embed, cache: str) -> DataFrame:
    """The vectors of :func:`embed_counted`."""
    return embed_counted(texts, embed, cache).vectors


def prototypes() -> list[tuple[str, str]]:
    """(subtype, phrase) of each subtype of the dictionary."""
    return [(s.code, " ".join((s.label.lower(), *s.synonyms[:3]))) for s in D.SUBTYPES]


def nearest_subtype(texts: DataFrame, embed: Embed, cache: str) -> DataFrame:
    """(text, forced, score): the subtype with the nearest phrase, NULL where none is near enough or a vector is missing.

    The phrases are as few as the subtypes, so their vectors travel as one literal; ties go to the first subtype.
    """
    codes, phrases = zip(*prototypes(), strict=True)
    near = ", ".join(f"struct(round({_dot([float(x) for x in v])}, 9) AS score, {-k} AS place, '{c}' AS code)" for k, (c, v) in enumerate(zip(codes, embed(list(phrases)), strict=True)) if v is not None)
    vectors = embed_texts(texts, embed, cache)
    best = vectors.selectExpr("text", f"IF(vector IS NULL, NULL, array_max(array({near}))) AS best" if near else "CAST(NULL AS STRUCT<score: DOUBLE, place: INT, code: STRING>) AS best")
    return best.selectExpr("text", f"IF(best.score > {LEAST}, best.code, NULL) AS forced", "best.score AS score")


def _dot(vector: list[float]) -> str:
    literal = "array(" + ", ".join(f"{x!r}D" for x in vector) + ")"
    return f"aggregate(zip_with(vector, {literal}, (a, b) -> CAST(a AS DOUBLE) * b), 0D, (acc, z) -> acc + z)"


def reclassify(rows: DataFrame, embed: Embed, cache: str) -> DataFrame:
    """Coded materials whose subtype is unknown, coded again by their nearest subtype.

    Returns raw_description, classified_by (``ai`` or ``rules``), ai_score and the columns of ``coded`` for
    each distinct unknown description.
    """
    unknown = rows.filter("subtype = 'UNK'").select("raw_description").distinct()
    guessed = nearest_subtype(unknown, embed, cache).selectExpr("text AS raw_description", "forced", "IF(forced IS NULL, NULL, score) AS ai_score", "IF(forced IS NULL, 'rules', 'ai') AS classified_by")
    view = f"guessed_{uuid.uuid4().hex}"
    materialise(guessed, "guessed").createOrReplaceTempView(view)
    return rows.sparkSession.sql(coded(SPARK, view, forced="forced"))
