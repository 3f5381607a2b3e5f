"""Op 7, removal of repeated byte strings by blockwise suffix comparison with
a precomputed cover sample.

To know whether the 100 bytes at a position stand earlier in the corpus it is
enough to order suffixes to a depth of 100. The sample is a cover: two
positions with equal 100 bytes reach sampled positions at the same distance.
Sampled suffixes are ranked first (class of the k-mer, then of the whole
context, repeats.py); a position is then settled by the rank of its sample,
and only positions whose sample's k-mer has several contexts compare their
own 100 bytes. The suffixes come in buckets by the k-mer of their sample; a
task sorts one bucket after the other in a stream, with bounded memory.

The cover is chosen by content instead of residues modulo a number: it holds
3 % of all positions instead of the 14-22 % of an arithmetic difference cover
of the same period, and needs no shift of ranks between texts.

Defined cases: null and empty texts have no bytes and lose none; a null id
comes after all others; rows equal in id and text are one document, and each
gets its result; rows equal in id alone are two documents in the order of a
hash of the text; very long texts are scanned in parts; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from acrewise.llm.common import on_arrow, table
from acrewise.llm.repeats import LAST, Repeats, documents, marked
from acrewise.llm.symbols import byte_values

LENGTH = 100
K = 32


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> what is left of each text."""
    for b in batches:
        out = []
        for i, text, spans in zip(*(c.to_pylist() for c in b.columns)):
            data = text.encode()
            gone = marked(len(data), spans)
            runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
            left = np.frombuffer(data, np.uint8)[~gone].tobytes() if runs else data
            out.append((i, len(data), len(data) - len(left), runs, left, hashlib.sha256(left).hexdigest()))
        cols = list(zip(*out)) or [[]] * 6
        types = [pa.int64()] * 4 + [pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def dedup(df, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K):
    """Per row of df: doc_id, n_bytes, n_removed, n_spans, kept (bytes),
    kept_sha256."""
    docs = documents(df, key, text)
    spans = Repeats(length, k, byte_values, every=False).marks(docs)
    rows = docs.join(spans, ["id", "fp"], "left").select(F.nullif("id", F.lit(LAST)).alias("doc_id"), "text", "spans")
    return on_arrow(rows, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op7(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents")).drop("kept")


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 99)) AS s, unnest(list_transform(range(0, len(h) // 2 - 99),
    lambda s: md5(substr(h, CAST(2 * s + 1 AS BIGINT), 200)))) AS k FROM d WHERE len(h) >= 200),
f AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
g AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g) GROUP BY doc_id, run),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS h FROM (
  SELECT doc_id, h, hi AS a, coalesce(lead(lo) OVER (PARTITION BY doc_id ORDER BY lo), len(h) // 2) AS b FROM (
    SELECT doc_id, lo, hi FROM r UNION ALL SELECT doc_id, -1, 0 FROM d) JOIN d USING (doc_id)) GROUP BY doc_id)
SELECT doc_id, len(d.h) // 2 AS n_bytes, len(d.h) // 2 - len(kept.h) // 2 AS n_removed,
  (SELECT count(*) FROM r WHERE r.doc_id = d.doc_id) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id)"""
