"""Survey-weighted estimates with replicate weights.

Method (Census Bureau PUMS replicate-weight method; the formulas of the
package the original called are not in the source): estimate with the
main weight, re-estimate with each of the 80 replicate weights,
var = 4/80 · Σ_r (est_r − est)², MOE = 1.645 · sqrt(var). A share divides a
group by its parent group (all group variables but the last), for the
main and every replicate weight. A median is the weighted percentile
(linear interpolation over the frequency-expanded values) and its MOE is
our own choice: the same replicate re-estimate.

All 81 weighted sums of a group come out of one aggregation (partial
aggregation before the shuffle, so a group holding a third of the rows
is summed map-side); parent totals are window sums over the small
aggregated result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrewise import params as P

DIGITS = 9   # output precision of estimates (keeps last-bit float noise out)


def _rep_cols(weight: str, n: int) -> list[str]:
    return [weight] + [f"{weight}{r}" for r in range(1, n + 1)]


def _moe(est: str, reps: list[str], n: int) -> str:
    """SQL text: 1.645 * sqrt(4/n * Σ (rep - est)²)."""
    sq = " + ".join(f"(({r}) - ({est})) * (({r}) - ({est}))" for r in reps)
    return f"{P.MOE_Z!r} * sqrt({4.0 / n!r} * ({sq}))"


def _grouping_sets_agg(df: DataFrame, group_sets: Sequence[Sequence[str]], all_vars: Sequence[str],
                       aggs: list[Column], level_col: str) -> DataFrame:
    """One aggregation for every grouping set (one scan, partial aggregation
    before the shuffle). Rows with a NULL in a variable of a set are left
    out of that set (incl_na = FALSE): variables used by every set are
    filtered before, the others after, telling a data NULL from a
    subtotal by ``grouping_id``."""
    used = [v for v in all_vars if any(v in gs for gs in group_sets)]
    common = [v for v in used if all(v in gs for gs in group_sets)]
    sub = df
    for v in common:
        sub = sub.filter(F.col(v).isNotNull())
    agg = sub.groupingSets([list(gs) for gs in group_sets], *used).agg(*aggs, F.grouping_id().alias("_gid"))
    n = len(used)
    level = None
    for i, gs in enumerate(group_sets):
        gid = sum(1 << (n - 1 - j) for j, v in enumerate(used) if v not in gs)
        cond = F.col("_gid") == gid
        for v in gs:
            cond = cond & F.col(v).isNotNull()
        level = F.when(cond, F.lit(i)) if level is None else level.when(cond, F.lit(i))
    out = agg.withColumn(level_col, level).filter(F.col(level_col).isNotNull()).drop("_gid")
    for v in all_vars:
        if v not in used:
            out = out.withColumn(v, F.lit(None).cast("string"))
    return out


def weighted_counts(df: DataFrame, group_sets: Sequence[Sequence[str]], all_vars: Sequence[str],
                    weight: str = "pwgtp", n_rep: int = P.N_REPLICATES,
                    level_col: str = "_level") -> DataFrame:
    """count, count_moe, share, share_moe per group of each grouping set.

    ``group_sets`` are lists of the ``all_vars`` columns (e.g. with and
    without the county), computed in one pass; rows with a NULL in any used
    group variable are left out (incl_na = FALSE). ``level_col`` tells the
    sets apart. Parent totals (all group variables but the last) are window
    sums over the small aggregated result.
    """
    ws = _rep_cols(weight, n_rep)
    sums = [F.expr(f"CAST(sum({w}) AS DOUBLE)").alias(f"_s{j}") for j, w in enumerate(ws)]
    out = _grouping_sets_agg(df, group_sets, all_vars, sums, level_col)
    res = None
    for i, gs in enumerate(group_sets):
        part = out.filter(F.col(level_col) == i)
        w = Window.partitionBy(level_col, *gs[:-1])
        part = part.select("*", *[F.sum(f"_s{j}").over(w).alias(f"_p{j}") for j in range(len(ws))])  # small: one row per group
        res = part if res is None else res.unionByName(part)
    out = res
    s = [f"_s{j}" for j in range(len(ws))]
    sh = [f"try_divide(_s{j}, _p{j})" for j in range(len(ws))]
    return out.selectExpr(*[f"`{v}`" for v in all_vars], level_col,
                          f"round({s[0]}, {DIGITS}) AS count",
                          f"round({_moe(s[0], s[1:], n_rep)}, {DIGITS}) AS count_moe",
                          f"round({sh[0]}, {DIGITS}) AS share",
                          f"round({_moe(sh[0], sh[1:], n_rep)}, {DIGITS}) AS share_moe")


#: Buckets of a group's values, cut at its quantiles.
BUCKETS = 256


def _by_set(df: DataFrame, group_sets: Sequence[Sequence[str]], all_vars: Sequence[str], level_col: str) -> DataFrame:
    """Each row once for every grouping set it belongs to (rows with a NULL in
    a variable of the set do not), the other variables NULL."""
    types = dict(df.dtypes)
    sets = [F.when(F.expr(" AND ".join(f"`{v}` IS NOT NULL" for v in gs) or "true"), F.struct(F.lit(i).alias(level_col), *[
        (F.col(v) if v in gs else F.lit(None).cast(types[v])).alias(v) for v in all_vars])) for i, gs in enumerate(group_sets)]
    x = df.withColumn("_set", F.explode(F.filter(F.array(*sets), lambda s: s.isNotNull())))
    return x.select("_set.*", *[c for c in df.columns if c not in all_vars])


def _cuts_below(cuts: str, v: str) -> str:
    """SQL text: how many of the sorted ``cuts`` are less than ``v``, found by
    halving (``BUCKETS`` - 1 cuts at most)."""
    return (f"aggregate(sequence(1, {BUCKETS.bit_length()}), named_struct('a', 0, 'b', size({cuts})), (s, i) -> CASE WHEN s.a >= s.b THEN s "
            f"WHEN {cuts}[(s.a + s.b) div 2] < {v} THEN named_struct('a', CAST((s.a + s.b) div 2 + 1 AS INT), 'b', s.b) "
            f"ELSE named_struct('a', s.a, 'b', CAST((s.a + s.b) div 2 AS INT)) END).a")


def weighted_medians(df: DataFrame, target: str, group_sets: Sequence[Sequence[str]],
                     all_vars: Sequence[str], weight: str = "pwgtp", n_rep: int = P.N_REPLICATES,
                     level_col: str = "_level") -> DataFrame:
    """<target>_median and its MOE per group: exact weighted medians (whole
    weights count how often a value occurs; the two middle ones are averaged).

    A selection in two steps, without a map of all values in one task. The
    values of a group are cut into ``BUCKETS`` at approximate quantiles, and
    the weights of a bucket are summed, for the main and all replicate weights
    at once; the sums tell which bucket holds the middle of each weight. Only
    the rows of those buckets, a few of 256, are then grouped by value. All
    sums are combined map-side, so a group holding a third of the rows is no
    task of its own."""
    ws = _rep_cols(weight, n_rep)
    n = len(ws)
    rows = _by_set(df.filter(F.col(target).isNotNull()).select(*dict.fromkeys([*all_vars, target, *ws])), group_sets, all_vars, level_col)
    # whole weights, and one key that may hold NULLs
    key = F.struct(level_col, *all_vars)
    rows = rows.select(F.to_json(key, {"ignoreNullFields": "false"}).alias("_key"), level_col, *all_vars, F.col(target).cast("double").alias("_v"),
                       *[F.coalesce(F.col(w).cast("bigint"), F.lit(0)).alias(f"_w{j}") for j, w in enumerate(ws)])
    cuts = rows.groupBy("_key").agg(F.array_distinct(F.percentile_approx("_v", [i / BUCKETS for i in range(1, BUCKETS)], 10_000)).alias("_cuts"))
    cut = rows.join(cuts, "_key").withColumn("_bucket", F.expr(_cuts_below("_cuts", "_v"))).drop("_cuts")

    sums = [F.sum(f"_w{j}").alias(f"_w{j}") for j in range(n)]
    hist = cut.groupBy("_key", "_bucket").agg(*sums)
    upto, whole = Window.partitionBy("_key").orderBy("_bucket"), Window.partitionBy("_key")  # BUCKETS rows a group
    hist = hist.select("_key", "_bucket", *[f"_w{j}" for j in range(n)],
                       F.array(*[F.sum(f"_w{j}").over(upto) - F.col(f"_w{j}") for j in range(n)]).alias("_below"),
                       F.array(*[F.sum(f"_w{j}").over(whole) for j in range(n)]).alias("_all"))
    # the middle of the weights is at (0-based) places (all - 1) div 2 and all div 2
    holds = " OR ".join(f"(_below[{j}] <= _all[{j}] div 2 AND _below[{j}] + _w{j} > (_all[{j}] - 1) div 2 AND _w{j} > 0)" for j in range(n))
    middle = hist.where(holds).select("_key", "_bucket", "_below", "_all")

    vals = cut.join(middle.select("_key", "_bucket"), ["_key", "_bucket"], "left_semi").groupBy("_key", "_bucket", "_v").agg(*sums)
    vals = vals.join(middle, ["_key", "_bucket"])
    inside = Window.partitionBy("_key", "_bucket").orderBy("_v")
    vals = vals.select("_key", "_v", "_all", *[f"_w{j}" for j in range(n)], *[(F.col("_below")[j] + F.sum(f"_w{j}").over(inside) - F.col(f"_w{j}")).alias(f"_b{j}") for j in range(n)])
    at = lambda j, place: F.max(F.expr(f"CASE WHEN _b{j} <= {place} AND {place} < _b{j} + _w{j} THEN _v END"))
    meds = vals.groupBy("_key").agg(*[(0.5 * at(j, f"(_all[{j}] - 1) div 2") + 0.5 * at(j, f"_all[{j}] div 2")).alias(f"_m{j}") for j in range(n)])
    out = rows.select("_key", level_col, *all_vars).distinct().join(meds, "_key", "left")
    m = [f"_m{j}" for j in range(n)]
    return out.selectExpr(*[f"`{v}`" for v in all_vars], level_col, f"round({m[0]}, {DIGITS}) AS {target}_median",
                          f"round({_moe(m[0], m[1:], n_rep)}, {DIGITS}) AS {target}_median_moe")
