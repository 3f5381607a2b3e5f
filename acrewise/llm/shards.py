"""Op 2, sharding by proportional stratified interleaving (DataFrame only).

Rows are shuffled by a seeded hash and ranked within their source; the
fractional rank (rank - 1/2) / (rows of the source) spreads every source
evenly over (0, 1); sorting by it interleaves the sources in proportion, and
equal cuts of that order are shards that all match the mixture.

Both rankings are global orders, yet no task sees more than one bucket: a
bucket is a range of the order, fixed by the row's own values, the bucket
counts give each bucket its offset, and ``row_number`` runs inside a bucket.
The buckets of a source grow in number with the shuffle width, so a source
that holds a third of all rows is spread like any other. The offsets of the
second ranking follow from the sizes of the sources alone (no second pass).

Defined cases: a null source is a source of its own; null ids and repeated
rows are ordinary rows (equal rows are interchangeable); an empty table gives
an empty result; input columns named like an output are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrewise.llm.common import names, partitions, table, with_outputs

SEED = "shard-1"
SHARDS = 8
BUCKETS_PER_TASK = 8


def interleave(df: DataFrame, n_shards: int = SHARDS, strata: str = "source", key: str = "doc_id",
               seed: str = SEED, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``shard`` (0..n_shards-1, sizes at most one apart) and
    ``slot`` (gapless from 0 in each shard). ``ties``: further columns that
    order rows whose key is equal."""
    nb = max(64, BUCKETS_PER_TASK * partitions(df.sparkSession))
    s, h, b, rank, n, frac, b2, pos, off, start, total = names(
        df, "stratum", "hash", "bucket", "rank", "n", "frac", "slice", "pos", "off", "start", "total")
    rows = df.withColumns({
        s: F.coalesce(F.concat(F.lit("s"), F.col(f"`{strata}`").cast("string")), F.lit("n")),
        h: F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))),
    })
    rows = rows.withColumn(b, F.shiftright(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * nb, 32).cast("int"))
    by_bucket = rows.groupBy(s, b).agg(F.count(F.lit(1)).alias("c"))
    mine = Window.partitionBy(s)
    offsets = by_bucket.select(
        F.col(s), F.col(b),
        (F.sum("c").over(mine.orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")).alias(off),
        F.sum("c").over(mine).alias(n))
    order = [F.col(h), F.col(f"`{key}`"), *[F.col(f"`{t}`") for t in ties]]
    ranked = (rows.withColumn(rank, F.row_number().over(Window.partitionBy(s, b).orderBy(*order)))
              .join(offsets, [s, b])
              .withColumn(rank, F.col(rank) + F.col(off)))
    odd = F.lit(2) * F.col(rank).cast("long") - 1
    ranked = ranked.withColumns({frac: odd.cast("double") / (2 * F.col(n)).cast("double"),
                                 b2: F.floor(F.expr(f"((2 * CAST(`{rank}` AS BIGINT) - 1) * {nb}) div (2 * `{n}`)")).cast("int")})
    # rows of each slice (a range of the fractional rank), from the sources' sizes alone
    sizes = by_bucket.groupBy(s).agg(F.sum("c").alias("n"))
    slices = (sizes.select("n", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(nb)).cast("int") - 1)).alias("i"))
              .select(F.expr(f"IF(n >= {nb}, i, ((2 * CAST(i AS BIGINT) + 1) * {nb}) div (2 * n))").cast("int").alias(b2),
                      F.expr(f"IF(n >= {nb}, (2 * n * (i + 1) + {nb - 1}) div {nb} div 2 - (2 * n * i + {nb - 1}) div {nb} div 2, 1)").alias("c"))
              .groupBy(b2).agg(F.sum("c").alias("c")))
    upto = Window.orderBy(b2).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = slices.select(F.col(b2), (F.sum("c").over(upto) - F.col("c")).alias(start),
                           F.sum("c").over(Window.partitionBy(F.lit(1))).alias(total))
    placed = (ranked.withColumn(pos, F.row_number().over(Window.partitionBy(b2).orderBy(frac, s, *order)))
              .join(F.broadcast(starts), b2)  # one row per slice: nb at most
              .withColumn(pos, F.col(pos) + F.col(start) - 1))
    shard = F.expr(f"(`{pos}` * {n_shards}) div `{total}`")
    first = F.expr(f"(((`{pos}` * {n_shards}) div `{total}`) * `{total}` + {n_shards - 1}) div {n_shards}")
    return placed.select(*with_outputs(df, {"shard": shard.cast("int"), "slot": (F.col(pos) - first).cast("long")}))


def op2(spark, sf_dir):
    """All documents into eight shards; law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return interleave(docs, ties=["text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def sql_interleave(src: str, n_shards: int = SHARDS, seed: str = SEED, ties: str = "doc_id") -> str:
    """DuckDB select of src's rows with ``shard`` and ``slot``."""
    return f"""
SELECT * EXCLUDE (st, hs, rk, ns, pos, total),
  CAST((pos * {n_shards}) // total AS INTEGER) AS shard,
  CAST(pos - (((pos * {n_shards}) // total) * total + {n_shards - 1}) // {n_shards} AS BIGINT) AS slot
FROM (SELECT *, row_number() OVER (ORDER BY CAST(2 * rk - 1 AS DOUBLE) / CAST(2 * ns AS DOUBLE), st, hs, {ties}) - 1 AS pos,
        count(*) OVER () AS total
  FROM (SELECT *, row_number() OVER (PARTITION BY st ORDER BY hs, {ties}) AS rk, count(*) OVER (PARTITION BY st) AS ns
    FROM (SELECT *, coalesce('s' || source, 'n') AS st,
            md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS hs FROM {src})))"""


#: CRC-32 with the reflected polynomial 0xEDB88320, byte by byte.
SQL_CRC32 = """
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(0, 256)) AS i)))"""

SQL = f"""
WITH {SQL_CRC32},
docs AS (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc_table)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, slot, CAST(NULL AS INTEGER) AS grown_shard
FROM ({sql_interleave("docs", ties="doc_id, text_crc32")})"""
