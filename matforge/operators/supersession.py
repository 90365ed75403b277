"""Retiring codes in favour of others: the rules that a proposal must pass, alone and within its batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from matforge.operators.pointers import cycle_names
from matforge.runtime import materialise

#: Shortest reason that the audit trail accepts.
SHORTEST_REASON = 3


def _view(df: DataFrame) -> str:
    import uuid

    name = f"v_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


def checked(proposals: str, codes: str, chain: str, ends: str) -> str:
    """SQL: each proposal with ``outcome``, ``ok`` or the first rule that it breaks against the registry as it stands.

    ``proposals`` has old_code, new_code and reason, ``codes`` the known nmc_code values, ``chain`` the registered old_code and new_code, ``ends``
    the nmc_code and root of each code. Blanks around codes and reasons do not count; nulls are blank.
    """
    old, new = "trim(coalesce(p.old_code, ''))", "trim(coalesce(p.new_code, ''))"
    return f"""
SELECT p.*, CASE WHEN {old} = '' OR {new} = '' THEN 'code missing' WHEN {old} = {new} THEN 'itself' WHEN length(trim(coalesce(p.reason, ''))) < {SHORTEST_REASON} THEN 'reason'
  WHEN o.nmc_code IS NULL THEN 'unknown code' WHEN n.nmc_code IS NULL THEN 'unknown replacement'
  WHEN s.old_code IS NOT NULL THEN 'already superseded by ' || s.new_code WHEN e.root = {old} THEN 'cycle' ELSE 'ok' END AS outcome
FROM {proposals} p LEFT JOIN (SELECT DISTINCT nmc_code FROM {codes}) o ON {old} = o.nmc_code LEFT JOIN (SELECT DISTINCT nmc_code FROM {codes}) n ON {new} = n.nmc_code
LEFT JOIN {chain} s ON {old} = s.old_code LEFT JOIN {ends} e ON {new} = e.nmc_code"""


def accepted(proposals: DataFrame, codes: DataFrame, chain: DataFrame, ends: DataFrame) -> DataFrame:
    """A batch of proposals (old_code, new_code, reason, place) with the outcome that taking them one by one in order of place has.

    Of several sound proposals for a code the first one counts; what then closes a cycle together with others is refused, the last of them.
    A code so freed goes to its next proposal, so the last two steps are repeated; each round refuses at least one proposal for good.
    """
    spark = proposals.sparkSession
    now = materialise(spark.sql(f"SELECT * EXCEPT (old_code, new_code), trim(old_code) AS old_code, trim(new_code) AS new_code FROM ({checked(_view(proposals), _view(codes), _view(chain), _view(ends))}) c"), "proposals")
    c = _view(chain)
    while True:
        name = _view(now)
        first = _view(materialise(spark.sql(f"SELECT old_code, min_by(new_code, place) AS new_code, min(place) AS place FROM {name} WHERE outcome = 'ok' GROUP BY old_code"), "first"))
        edges = spark.sql(f"SELECT old_code, new_code FROM {first} UNION ALL SELECT old_code, new_code FROM {c}")
        loops = cycle_names(edges, "old_code", "new_code")
        last = materialise(spark.sql(f"SELECT max(place) AS place FROM {first} f JOIN {_view(loops)} l ON f.old_code = l.old_code GROUP BY cycle"), "last")
        if last.isEmpty():
            later = f"SELECT p.* EXCEPT (outcome), CASE WHEN p.outcome = 'ok' AND p.place > f.place THEN 'already superseded by ' || f.new_code ELSE p.outcome END AS outcome FROM {name} p LEFT JOIN {first} f ON p.old_code = f.old_code"
            return materialise(spark.sql(later), "proposals")
        now = materialise(spark.sql(f"SELECT p.* EXCEPT (outcome), CASE WHEN l.place IS NOT NULL THEN 'cycle' ELSE p.outcome END AS outcome FROM {name} p LEFT JOIN {_view(last)} l ON p.place = l.place"), "proposals")
