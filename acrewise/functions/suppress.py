"""Disclosure-suppressed employment count.

Per group, in order:
1. covered jobs below 0.4 -> '0'
2. no private-sector rows -> rounded count (public only, never suppressed)
3. one or two private rows, or the largest private workplace holds over 80%
   of private raw jobs, or confidential firms hold over 80% -> 'S'
4. otherwise the rounded count as text.

The rule is a scalar on five aggregates (four sums and a maximum), which merge:
cells aggregated once can be aggregated further before the rule is applied.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the rule
ZERO_BELOW = 0.4
DOMINANCE_SHARE = 0.8
FEW_PRIVATE = (1, 2)


def suppression_inputs(covered: str = "jobcount_covered", raw: str = "jobcount_raw",
                       private: str = "private_sector", confid: str = "confid_firm_id") -> list[Column]:
    rp = F.col(raw) * F.col(private)
    # NULL firm id counts as confidential (ELSE branch of the original CASE)
    conf_flag = F.when(F.col(confid) == 0, F.lit(0)).otherwise(F.lit(1))
    return [F.sum(covered).alias("_s_cov"), F.sum(private).alias("_s_priv"), F.sum(rp).alias("_s_rp"),
            F.max(rp).alias("_m_rp"), F.sum(rp * conf_flag).alias("_s_rpc")]


def suppression_merge() -> list[Column]:
    """Aggregates over columns made by ``suppression_inputs``."""
    return [*[F.sum(c).alias(c) for c in ("_s_cov", "_s_priv", "_s_rp", "_s_rpc")], F.max("_m_rp").alias("_m_rp")]


def suppression_rule() -> Column:
    """The rule over the columns made by ``suppression_inputs``."""
    rounded = "CAST(CAST(round(_s_cov, 0) AS INT) AS STRING)"
    return F.expr(
        f"CASE WHEN _s_cov < {ZERO_BELOW} THEN '0' WHEN _s_priv = 0 THEN {rounded} "
        f"WHEN _s_priv IN {FEW_PRIVATE} OR try_divide(_m_rp, _s_rp) > {DOMINANCE_SHARE} "
        f"OR try_divide(_s_rpc, _s_rp) > {DOMINANCE_SHARE} THEN 'S' ELSE {rounded} END")
