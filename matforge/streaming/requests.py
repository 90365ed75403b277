"""Publish-and-ask requests as a stream: whole requests are taken or refused, and answered from keyed state.

A request is a JSON body that names an organisation and one code or several. Each code's state is the set of organisations that have published it; a request
learns which others were there before it and joins them. Requests of one batch are taken in the order of ``place``, so answers are as of arrival,
and any number of writers of one code lose nothing: they meet in its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matforge.streaming.published import CODE, CODE_LENGTH, ORGANISATION, ORGANISATION_LENGTH

#: Codes and characters in a request.
MOST_CODES, MOST_BODY = 500, 256 * 1024
ANSWERS = "request_id string, nmc_code string, cpse_id string, others string, published boolean"


def checked(rows: DataFrame) -> DataFrame:
    """Requests (request_id, place, method, body) with cpse_id, their distinct codes, and status and problem of those refused.

    The first rule that a request breaks refuses all of it: the method (405), the length (413), then the form of its body (400). A null
    body is no JSON; a null method is none.
    """
    kind = lambda name: f"schema_of_variant(try_variant_get(v, '$.{name}', 'variant'))"
    told = rows.withColumn("v", F.expr("try_parse_json(body)")).selectExpr(
        "*",
        f"CASE WHEN {kind('cpseId')} = 'STRING' THEN try_variant_get(v, '$.cpseId', 'string') END AS cpse_id",
        f"CASE WHEN {kind('nmcCode')} = 'STRING' THEN array(try_variant_get(v, '$.nmcCode', 'string')) WHEN {kind('nmcCodes')} = 'ARRAY<STRING>' THEN try_variant_get(v, '$.nmcCodes', 'array<string>') END AS named",
        f"CASE WHEN {kind('nmcCode')} = 'STRING' THEN 1 ELSE size(try_variant_get(v, '$.nmcCodes', 'array<variant>')) END AS n",
    )
    form = lambda x, pattern, most: f"({x} IS NULL OR length({x}) > {most} OR NOT {x} RLIKE '{pattern}')"
    problem = f"""CASE WHEN coalesce(method, '') <> 'POST' THEN 'method' WHEN length(body) > {MOST_BODY} THEN 'too large' WHEN v IS NULL THEN 'no JSON' WHEN schema_of_variant(v) NOT LIKE 'OBJECT%' THEN 'no object'
  WHEN {form('cpse_id', ORGANISATION, ORGANISATION_LENGTH)} THEN 'organisation' WHEN coalesce(n, -1) <= 0 THEN 'no codes' WHEN n > {MOST_CODES} THEN 'too many codes'
  WHEN named IS NULL OR exists(named, c -> {form('c', CODE, CODE_LENGTH)}) THEN 'code' END"""
    judged = told.withColumn("problem", F.expr(problem))
    status = "CASE problem WHEN 'method' THEN 405 WHEN 'too large' THEN 413 ELSE IF(problem IS NULL, 200, 400) END"
    return judged.selectExpr("request_id", "place", "cpse_id", "CASE WHEN problem IS NULL THEN array_distinct(named) END AS codes", f"{status} AS status", "problem")


def _answer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the organisations of one code, joined by line ends, which no organisation's name holds."""
    known = set(state.get[0].split("\n")) if state.exists else set()
    rows = pd.concat(list(frames)).sort_values(["place", "request_id"])
    out = []
    for request, organisation in zip(rows["request_id"], rows["cpse_id"]):
        out.append((request, key[0], organisation, "|".join(sorted(known - {organisation})), organisation not in known))
        known.add(organisation)
    state.update(("\n".join(sorted(known)),))
    yield pd.DataFrame(out, columns=["request_id", "nmc_code", "cpse_id", "others", "published"])


def answers(rows: DataFrame) -> DataFrame:
    """Of a stream of requests, one row per accepted request and code: the others that were there before, and whether it is newly published.

    State is a set of organisations per code, bounded by their number; it is kept by code, so a batch reads that of its own codes only.
    """
    asked = checked(rows).filter("problem IS NULL").select("request_id", "place", "cpse_id", F.explode("codes").alias("nmc_code"))
    return asked.groupBy("nmc_code").applyInPandasWithState(_answer, ANSWERS, "organisations string", "append", GroupStateTimeout.NoTimeout)
