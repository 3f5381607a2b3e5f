"""Op 10, line dedup with keep bitmaps.

Every line gives a 128-bit hash of its key. The hashes are range-partitioned
and sorted within each partition by document and position; one stream over
the sorted rows remembers the first document of the current hash and marks
the lines of all later ones. The marks come back as a compressed bitmap per
document; the texts themselves are never shuffled for the decision.

A line that stands in very many documents would fill one partition, so the
most frequent hashes (their number bounded by ``HOT_KEYS``) take a second
way: their first documents come from a map-side combined minimum, are
broadcast (32 bytes each) and applied where the rows are read. What is left
has at most rows / HOT_KEYS lines a hash.

Defined cases: null and empty texts are one empty line; null ids are one
document that comes after all others; rows equal in id and text get equal
bitmaps; rows equal in id alone are one document holding both texts; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrewise.llm.common import on_arrow, partitions, row_key, scratch, stored, table

MIN_CHARS = 10
HOT_LINES = 256      # lines of a hash from which it can count as hot
HOT_KEYS = 100_000   # hot hashes at most: bounds the broadcast to a few MB
LAST = 2**63 - 1     # stands for a null id
BLANKS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})


def line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, fp, text) -> one row per line whose key is long enough."""
    for b in batches:
        ids, fps, h1, h2, at = [], [], [], [], []
        for i, fp, text in zip(*(c.to_pylist() for c in b.columns)):
            for k, line in enumerate(text.split("\n") if text else ()):
                key = line.strip(BLANKS)
                if len(key) >= MIN_CHARS:
                    d = hashlib.blake2b(key.translate(FOLD).encode(), digest_size=16).digest()
                    ids.append(i)
                    fps.append(fp)
                    h1.append(int.from_bytes(d[:8], "little", signed=True))
                    h2.append(int.from_bytes(d[8:], "little", signed=True))
                    at.append(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in ((h1, pa.int64()), (h2, pa.int64()), (ids, pa.int64()), (fps, pa.int64()), (at, pa.int32()))],
            ["h1", "h2", "id", "fp", "at"])


def later_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash, id, position -> those not of the hash's first id.
    Carries one hash and its first id from batch to batch."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, ids = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        start = np.flatnonzero(new)
        first = ids[start].copy()
        if last is not None and (h1[0], h2[0]) == last[:2]:
            first[0] = last[2]
        owner = first[np.cumsum(new) - 1]
        last = (h1[-1], h2[-1], owner[-1])
        yield b.filter(pa.array(ids != owner)).select(["id", "fp", "at"])


def bitmaps(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, keep): for every document that loses lines, its row key and the
    zlib-compressed bits of its lines (1: stays, first line first)."""
    k = row_key(df, key, text)
    docs = df.select(F.coalesce(k["id"], F.lit(LAST)).alias("id"), k["fp"].alias("fp"), F.col(f"`{text}`").alias("text")).dropna(subset=["text"])
    # written once: the hashes are read three times, the texts once
    lines = stored(on_arrow(docs, line_hashes, "h1 long, h2 long, id long, fp long, at int"), scratch(df.sparkSession), "lines")
    hot = (lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("owner"))
           .where(F.col("n") >= HOT_LINES).orderBy(F.desc("n"), "h1", "h2").limit(HOT_KEYS).drop("n"))
    tagged = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    direct = tagged.where(F.col("owner") < F.col("id")).select("id", "fp", "at")
    n = partitions(df.sparkSession)
    sorted_ = (tagged.where(F.col("owner").isNull()).drop("owner").repartitionByRange(n, "h1", "h2")
               .sortWithinPartitions("h1", "h2", "id", "at"))
    streamed = on_arrow(sorted_, later_lines, "id long, fp long, at int")
    marks = direct.union(streamed).groupBy("id", "fp").agg(F.array_sort(F.collect_set("at")).alias("drop"))
    return marks.select(F.struct(F.nullif("id", F.lit(LAST)).alias("id"), "fp").alias("k"), "drop")


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, drop) -> counts, keep bitmap and digest of the rest."""
    for b in batches:
        ids, n, gone, bits, sha = [], [], [], [], []
        for i, text, drop in zip(*(c.to_pylist() for c in b.columns)):
            lines = (text or "").split("\n")
            keep = np.ones(len(lines), bool)
            if drop:
                keep[drop] = False
            ids.append(i)
            n.append(len(lines))
            gone.append(len(drop or ()))
            bits.append(zlib.compress(np.packbits(keep).tobytes()))
            sha.append(hashlib.sha256("\n".join(x for x, y in zip(lines, keep) if y).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in ((ids, pa.int64()), (n, pa.int64()), (gone, pa.int64()), (bits, pa.binary()), (sha, pa.string()))],
            ["doc_id", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256"])


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: doc_id, n_lines, n_dropped, keep_bitmap, kept_sha256."""
    marks = bitmaps(df, key, text)
    rows = df.select(row_key(df, key, text).alias("j"), F.col(f"`{text}`").alias("text"))
    both = rows.join(marks, rows["j"].eqNullSafe(marks["k"]), "left").select(F.col("j.id").alias("doc_id"), "text", "drop")
    return on_arrow(both, finish, "doc_id long, n_lines long, n_dropped long, keep_bitmap binary, kept_sha256 string")


def op10(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents")).drop("keep_bitmap")


# DuckDB's lower() folds all letters; translate() folds A-Z alone.
SQL = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
