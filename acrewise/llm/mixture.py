"""Op 8, mixing sources to target weights by iterative proportional fitting
(DataFrame only).

Tokens are summed by cell (source, language, topic). Raking multiplies the
cells in turn so that the sums by source, by language and by topic meet their
targets, until all three hold: after every ``ROUNDS`` rounds the largest gap
between a sum and its target is taken, and raking goes on while it is over
``TOLERANCE``. Targets that cannot be met together are reported as a warning
once ``ROUNDS`` more rounds hardly narrow the gap. A document's probability is its cell's fitted
weight over its cell's tokens, scaled so that the largest is 1: the expected
tokens of the sample have the fitted mixture, and no text is needed twice.

Targets are shares of the tokens. By source and by topic they are flattened
(share ** ``FLATTEN``, so that a source that holds a third of the corpus
counts less than that); by language they are given, and the languages that
are not listed divide what is left in proportion to their tokens.

The topic of a document is read off its layout (there is no topic column):
table, listing, short or prose.

Cells, not rows, are raked: rows are summed map-side, so hot sources cost
nothing. The cells are written once, one row a source, and a round is one small
aggregate over them; sources may be many, languages and topics are few (their
factors are constants of the next round's plan). The verdict is a seeded hash
of the id.

Defined cases: a null source or language is a value of its own; null and
empty texts have no tokens, count nothing and get the probability of their
cell (0 if nothing in the cell has tokens); null ids share one random number;
equal rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrewise.llm.common import BLANK, fixed, names, scratch, stored, table, with_outputs

SEED = "mix-1"
FLATTEN = 0.9
LANGUAGES = {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.13}
ROUNDS = 12
TOLERANCE = 1e-9  # share of the tokens
STALLED = 0.999   # of the gap left by a further ROUNDS rounds
SHORT = 100


def topic(text: Column, tokens: Column) -> Column:
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return (F.when(tokens < SHORT, "short").when(F.regexp_count(text, F.lit(r" \| ")) * 4 > tokens, "table")
            .when(lines * 12 > tokens, "listing").otherwise("prose"))


def tokens(text: Column) -> Column:
    """Words: the ends of runs of blanks, plus one."""
    inner = F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, BLANK + "+"))).cast("long")


def described(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its cell and tokens."""
    t, n = names(df, "body", "tokens")
    x = fixed(df, **{t: F.coalesce(F.col(f"`{text}`"), F.lit(""))})
    x = fixed(x, **{n: tokens(F.col(t))})
    return x.select(*with_outputs(df, {"topic": topic(F.col(t), F.col(n)), "tokens": F.col(n)}))


def targets(cells: DataFrame, by: str, given: dict[str, float] | None = None, flatten: float = FLATTEN) -> DataFrame:
    """(by, target): the share of the tokens that each value shall have."""
    sums = cells.groupBy(by).agg(F.sum("n").cast("double").alias("v"))
    if given is None:
        sums = sums.withColumn("v", F.pow("v", flatten))
        return sums.select(by, (F.col("v") / F.lit(sums.agg(F.sum("v")).first()[0])).alias("target"))
    share = F.lit(None).cast("double")
    for name, x in given.items():
        share = F.when(F.col(by) == "v" + name, x).otherwise(share)
    sums = sums.withColumn("g", share)
    listed, others = sums.agg(F.coalesce(F.sum("g"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("g").isNull(), F.col("v"))), F.lit(0.0))).first()
    left = max(0.0, 1.0 - listed) if others else 0.0
    return sums.select(by, (F.coalesce("g", F.lit(left) * F.col("v") / F.lit(others or None)) / F.lit((listed + left) or None)).alias("target"))


def _map(values: dict[str, float]) -> Column:
    if not values:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])


def _sum(cells: Column, term) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda s, x: s + term(x))


def rake(cells: DataFrame, languages: dict[str, float] = LANGUAGES, flatten: float = FLATTEN, rounds: int = ROUNDS) -> DataFrame:
    """cells (s, l, t, n) with n > 0 -> the same with the fitted weight w.

    The weight is n times a factor of each of the source, the language and the
    topic. Each source is one row with its cells (one for each language and
    topic), so its own factor needs no shuffle; the factors of the languages
    and topics, which are few, come out of one small sum over all sources a
    round and go into the next round as constants."""
    spark = cells.sparkSession
    few = {}
    for by, given in (("l", languages), ("t", None)):
        goal = targets(cells, by, given, flatten)
        few[by] = goal.agg(F.map_from_entries(F.collect_list(F.struct(by, F.coalesce("target", F.lit(0.0)))))).first()[0]
    rows = cells.groupBy("s").agg(F.collect_list(F.struct("l", "t", F.col("n").cast("double").alias("n"))).alias("cells"))
    rows = stored(rows.join(targets(cells, "s", flatten=flatten), "s"), scratch(spark), "sources")
    goal_l, goal_t = _map(few["l"]), _map(few["t"])

    def source_factor(b: Column, c: Column) -> Column:
        total = _sum(F.col("cells"), lambda x: x["n"] * b[x["l"]] * c[x["t"]])
        return F.when(total > 0, F.col("target") / total).otherwise(0.0)

    def round_of(now: tuple, before: tuple | None) -> tuple:
        """Factors of the languages and topics after one more round, the gap
        of the languages then, and that of the sources before it."""
        b, c = (_map(x) for x in now)
        a = source_factor(b, c)
        moved = F.lit(0.0)
        if before is not None:
            moved = F.abs(source_factor(*(_map(x) for x in before)) * _sum(F.col("cells"), lambda x: x["n"] * b[x["l"]] * c[x["t"]]) - F.col("target"))
        part = fixed(rows, a=a, moved=moved).select("moved", "a", F.explode("cells").alias("x")).groupBy("x.l", "x.t").agg(
            F.sum(F.col("x.n") * F.col("a")).alias("g"), F.max("moved").alias("moved"))
        whole = fixed(part.agg(F.collect_list(F.struct("l", "t", "g")).alias("g"), F.max("moved").alias("moved")), c0=c, goal_l=goal_l, goal_t=goal_t)

        def factors(by: str, goal: str, other):
            def one(k: Column) -> Column:
                total = _sum(F.filter("g", lambda x: x[by] == k), lambda x: x["g"] * other(x))
                return F.struct(k, F.when(total > 0, F.col(goal)[k] / total).otherwise(0.0))
            return F.map_from_entries(F.transform(F.array_distinct(F.transform("g", lambda x: x[by])), one))
        whole = fixed(whole, b=factors("l", "goal_l", lambda x: F.col("c0")[x["t"]]))
        whole = fixed(whole, c=factors("t", "goal_t", lambda x: F.col("b")[x["l"]]))
        off = F.array_max(F.transform(F.map_keys("b"), lambda k: F.abs(
            F.col("b")[k] * _sum(F.filter("g", lambda x: x["l"] == k), lambda x: x["g"] * F.col("c")[x["t"]]) - F.col("goal_l")[k])))
        r = whole.select("b", "c", off, "moved").first()
        return (r[0], r[1]), r[2] or 0.0, r[3] or 0.0

    now = tuple(dict.fromkeys(few[by], 1.0) for by in "lt")
    before, i, last, off_l = None, 0, None, 0.0
    while few["l"]:
        for _ in range(rounds):
            now, before, off_l = (r := round_of(now, before))[0], now, r[1]
            i += 1
        off = max(off_l, round_of(now, before)[2])
        if off <= TOLERANCE:
            break
        if last is not None and off > STALLED * last:
            warnings.warn(f"the mixture's targets cannot be met together: {off:.3g} of the tokens off after {i} rounds", RuntimeWarning, stacklevel=2)
            break
        last = off
    b, c = (_map(x) for x in now)
    a = source_factor(*(_map(x) for x in before or now))
    return fixed(rows, a=a).select("s", "a", F.explode("cells").alias("x")).select(
        "s", "x.l", "x.t", F.col("x.n").cast("long").alias("n"), (F.col("x.n") * F.col("a") * b[F.col("x.l")] * c[F.col("x.t")]).alias("w"))


def value(c: str) -> Column:
    """A column as text that keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("-"))


def mix(df: DataFrame, source: str = "source", lang: str = "lang", key: str = "doc_id", text: str = "text", seed: str = SEED,
        languages: dict[str, float] = LANGUAGES, columns: list[str] | None = None) -> DataFrame:
    """df with ``topic``, ``tokens``, ``probability`` and ``selected``. With
    ``columns`` only those of df's columns; if the text is not one of them, the
    texts are read once and the narrow rows stored."""
    x = described(df, text)
    if columns is not None:
        df, x = df.select(*columns), x.select(*columns, "topic", "tokens")
        if text not in columns:
            x = stored(x, scratch(df.sparkSession), "described")
    s, l, t = names(x, "s", "l", "t")
    x = x.withColumns({s: value(source), l: value(lang), t: F.col("topic")})
    cells = x.groupBy(F.col(s).alias("s"), F.col(l).alias("l"), F.col(t).alias("t")).agg(F.sum("tokens").alias("n")).where("n > 0")
    fitted = rake(stored(cells, scratch(df.sparkSession), "cells"), languages)
    ratio = F.col("w") / F.col("n")
    largest = fitted.agg(F.max(ratio)).first()[0]
    (p,) = names(x, "p")
    odds = fitted.select(F.col("s").alias(s), F.col("l").alias(l), F.col("t").alias(t),
                         F.round(F.try_divide(ratio, F.lit(largest)), 9).alias(p))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    y = x.join(odds, [s, l, t], "left").withColumn(p, F.coalesce(F.col(p), F.lit(0.0)))
    return y.select(*with_outputs(df, {"topic": F.col("topic"), "tokens": F.col("tokens"), "probability": F.col(p), "selected": u < F.col(p)}))


def op8(spark, sf_dir):
    """Every document with its calibrated probability and verdict."""
    return mix(table(spark, sf_dir, "documents"), columns=["doc_id", "source", "lang"]).select("doc_id", "source", "lang", "topic", "tokens", "probability", "selected")


def sample(df: DataFrame) -> DataFrame:
    """Pipeline form: the selected rows, columns unchanged."""
    outputs = ("topic", "tokens", "probability", "selected")
    hidden = {c: names(df, f"old_{c}")[0] for c in df.columns if c.lower() in outputs}
    kept = mix(df.withColumnsRenamed(hidden)).where("selected")
    return kept.select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in df.columns])


def sql_mix(src: str = "documents", p: str = "m", rounds: int = ROUNDS) -> str:
    """CTEs ending in ``{p}_mixed`` (src's columns, topic, tokens,
    probability, selected)."""
    flat = f"pow(CAST(sum(n) AS DOUBLE), {FLATTEN})"
    given = " ".join(f"WHEN 'v{k}' THEN {v}" for k, v in LANGUAGES.items())
    out = f"""
{p}_x AS (SELECT *, coalesce(text, '') AS body, CAST(len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM {src}),
{p}_c AS (SELECT *, coalesce('v' || source, '-') AS s, coalesce('v' || lang, '-') AS l,
  CASE WHEN tokens < {SHORT} THEN 'short' WHEN len(regexp_extract_all(body, ' \\| ')) * 4 > tokens THEN 'table'
    WHEN (len(regexp_extract_all(body, '\\n')) + 1) * 12 > tokens THEN 'listing' ELSE 'prose' END AS topic FROM {p}_x),
{p}_n AS (SELECT s, l, topic AS t, CAST(sum(tokens) AS BIGINT) AS n FROM {p}_c GROUP BY ALL HAVING sum(tokens) > 0),
{p}_ts AS (SELECT s, v / sum(v) OVER () AS ts FROM (SELECT s, {flat} AS v FROM {p}_n GROUP BY s)),
{p}_tt AS (SELECT t, v / sum(v) OVER () AS tt FROM (SELECT t, {flat} AS v FROM {p}_n GROUP BY t)),
{p}_l0 AS (SELECT l, CASE l {given} END AS g, CAST(sum(n) AS DOUBLE) AS v FROM {p}_n GROUP BY l),
{p}_l1 AS (SELECT l, g, v, coalesce(sum(g) OVER (), 0) AS gs, coalesce(sum(v) FILTER (WHERE g IS NULL) OVER (), 0) AS os FROM {p}_l0),
{p}_tl AS (SELECT l, coalesce(g, greatest(0, 1 - gs) * v / os) / (gs + CASE WHEN os > 0 THEN greatest(0, 1 - gs) ELSE 0 END) AS tl FROM {p}_l1),
{p}_w0 AS (SELECT s, l, t, n, ts, tl, tt, CAST(n AS DOUBLE) AS w FROM {p}_n JOIN {p}_ts USING (s) JOIN {p}_tl USING (l) JOIN {p}_tt USING (t))"""
    k = 0
    for _ in range(rounds):
        for by in "slt":
            k += 1
            out += f",\n{p}_w{k} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {by}) > 0 THEN w * t{by} / sum(w) OVER (PARTITION BY {by}) ELSE 0 END AS w) FROM {p}_w{k - 1})"
    return out + f""",
{p}_o AS (SELECT s, l, t AS topic, round(w / n / max(w / n) OVER (), 9) AS pr FROM {p}_w{k}),
{p}_mixed AS (SELECT {p}_c.* EXCLUDE (body, s, l), coalesce(pr, 0) AS probability,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 < coalesce(pr, 0) AS selected
  FROM {p}_c LEFT JOIN {p}_o USING (s, l, topic))"""


SQL = f"WITH {sql_mix()} SELECT doc_id, source, lang, topic, tokens, probability, selected FROM m_mixed"
