"""Op 1, benchmark decontamination with spaced seeds (DataFrame only).

A text leaks a benchmark item if ``WINDOW`` consecutive words of both agree
in all but ``SUBSTITUTIONS`` places (an item shorter than the window must be
there whole and unchanged). Words are letters and digits, lower-cased.

A seed is a fixed mask laid over the words at a position; the places marked 0
are ignored, the others are hashed together. Every window with the allowed
substitutions holds at least one place where one of the two masks meets only
equal words (a test goes through all cases), so joining the seeds of texts
and items finds every leak. Around each hit the windows that hold it are
compared word by word.

The seeds of the benchmark are broadcast if they are few (``MAX_BROADCAST``,
counted); then no seed of a text is ever shuffled or stored. Beyond that the
seeds meet in a shuffle join that carries positions only.

Defined cases: null texts and items have no words; items of less than
``MIN_ITEM`` words are not searched for; null ids are ids like any other;
rows equal in id and text give one result; very long texts stay one row; an
empty table or benchmark gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrewise.llm.common import fixed, matching, row_key, table

WINDOW = 15
SUBSTITUTIONS = 2
MASKS = ("1110100111", "11110111")
MIN_ITEM = 8               # the shorter mask's span
MAX_BROADCAST = 1_000_000  # seeds of the benchmark: 24 bytes each, and its words


def word_hashes(text: Column) -> Column:
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(w, lambda x: F.xxhash64(x))


def seeds(df: DataFrame, h: str, at: str) -> DataFrame:
    """A row for each position of the array ``h`` and each mask that fits:
    ``at`` (position) and ``seed``."""
    places = df.withColumn(at, F.explode(F.when(F.size(h) >= MIN_ITEM, F.sequence(F.lit(0), F.size(h) - MIN_ITEM))))
    return places.withColumn("seed", F.explode(F.array(*[
        F.when(F.col(at) + len(m) <= F.size(h), F.xxhash64(F.lit(n), *[F.get(h, F.col(at) + i) for i, c in enumerate(m) if c == "1"]))
        for n, m in enumerate(MASKS)]))).where("seed IS NOT NULL")


def around(words: str, at: str):
    """What a window that holds the seed at ``at`` can reach."""
    before = F.least(F.col(at), F.lit(WINDOW - 1))
    return F.slice(words, F.col(at) - before + 1, before + WINDOW), before


def best_window() -> Column:
    """Most equal words in a window of ``size`` that holds the seed, which is
    at ``p`` of the text's words ``h`` and at ``q`` of the item's ``g``; null
    if none fits."""
    shifts = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda t: (t <= F.col("p")) & (t <= F.col("q")) & (
        F.col("p") - t + F.col("size") <= F.size("h")) & (F.col("q") - t + F.col("size") <= F.size("g")))
    return F.array_max(F.transform(shifts, lambda t: F.size(F.filter(
        F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.get("h", F.col("p") - t + i) == F.get("g", F.col("q") - t + i)))))


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
          max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(k, item_id, best_match): row keys of df with the items they hold and
    the most equal words of a window."""
    items = fixed(benchmark.select(F.col(f"`{item}`").alias("item_id"), F.col(f"`{item_text}`").alias("t")), g=word_hashes(F.col("t"))).drop("t")
    docs = df.select(row_key(df, key, text).alias("k"), F.col(f"`{text}`").alias("t"))
    docs = fixed(docs, h=word_hashes(F.col("t"))).drop("t")
    theirs, ours = seeds(items, "g", "q"), seeds(docs, "h", "p")
    n = items.agg(F.sum(F.size("g"))).first()[0] or 0
    if len(MASKS) * n <= max_broadcast:
        hits = ours.join(F.broadcast(theirs), "seed")
    else:
        found = ours.select("k", "p", "seed").join(theirs.select("item_id", "q", "seed"), "seed").distinct()
        both = found.join(docs.dropDuplicates(["k"]).withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")))
        hits = both.join(items.withColumnRenamed("item_id", "i2"), F.col("item_id").eqNullSafe(F.col("i2")))
    # from here on a hit carries only the words near it, however long the text
    (h, p), (g, q) = around("h", "p"), around("g", "q")
    near = hits.select("k", "item_id", F.least(F.lit(WINDOW), F.size("g")).alias("size"), h.alias("h"), p.alias("p"), g.alias("g"), q.alias("q"))
    need = F.when(F.col("size") == WINDOW, WINDOW - SUBSTITUTIONS).otherwise(F.col("size"))
    scored = fixed(near, best=best_window()).where(F.col("best") >= need)
    return scored.groupBy("k", "item_id").agg(F.max("best").cast("long").alias("best_match"))


def op1(spark, sf_dir):
    """One row for each document and item that it leaks."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        F.col("k.id").alias("doc_id"), "item_id", "best_match")


def clean(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline form: the rows that leak nothing, columns unchanged."""
    return matching(df, row_key(df, "doc_id", "text"), leaks(df, benchmark).select("k").distinct(), "left_anti")


def sql_leaks(src: str = "documents", p: str = "l") -> str:
    """CTEs ending in ``{p}_leaks``: all alignments, without seeds."""
    w = lambda t: f"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""
{p}_d AS (SELECT doc_id, {w("text")} AS w FROM {src}),
{p}_b AS (SELECT item_id, {w("text")} AS w, least({WINDOW}, len(w)) AS size, CASE WHEN len(w) >= {WINDOW} THEN {WINDOW - SUBSTITUTIONS} ELSE len(w) END AS need
  FROM benchmark WHERE len(w) >= {MIN_ITEM}),
{p}_dt AS (SELECT doc_id, len(w) AS n, unnest(w) AS t, unnest(range(len(w))) AS i FROM {p}_d),
{p}_bt AS (SELECT item_id, len(w) AS m, size, need, unnest(w) AS t, unnest(range(len(w))) AS j FROM {p}_b),
{p}_diag AS (SELECT doc_id, item_id, n, m, size, need, i - j AS off, list(j) AS js
  FROM {p}_dt JOIN {p}_bt USING (t) GROUP BY ALL HAVING count(*) >= need),
{p}_win AS (SELECT *, unnest(range(m - size + 1)) AS q FROM {p}_diag),
{p}_leaks AS (SELECT doc_id, item_id, max(c) AS best_match FROM (
    SELECT *, len(list_filter(js, lambda j: j >= q AND j < q + size)) AS c FROM {p}_win WHERE q + off >= 0 AND q + off + size <= n)
  WHERE c >= need GROUP BY doc_id, item_id)"""


SQL = f"WITH {sql_leaks()} SELECT doc_id, item_id, best_match FROM l_leaks"
