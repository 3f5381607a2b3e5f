"""Op 9, substring dedup on a compacted De Bruijn graph of token k-mers.

Nodes are the k-mers of words that repeat in the corpus with their whole
context (a class of repeats.py); an edge joins a node to the next one of the
same text and carries their distance. An edge is nonbranching if all
occurrences of both its nodes take it. Nonbranching edges compact into paths
by pointer jumping, a join of the edges with themselves that doubles what
they span in each round; an occurrence of a path in a text is then one row,
however long it is. The source coordinates verify it: a row counts as one
span only if every node of the path between its ends is there. Where texts
part (a k-mer with several contexts) the windows are spelled out and compared
one by one. Words covered by a window of 35 that stands anywhere else go.

The graph is held on a sample of the k-mers chosen by content (one in every
window at least), about 8 % of all edges.

Defined cases: null and empty texts have no words and lose none; rows equal
in id and text are one document (they do not repeat each other), and each
gets its result; rows equal in id alone are two documents; null ids are ids
like any other; very long texts are scanned in parts; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrewise.llm.common import dropped, on_arrow, stored, table
from acrewise.llm.repeats import LAST, Repeats, documents, marked
from acrewise.llm.symbols import word_values

LENGTH = 35
K = 12


class Graph(Repeats):
    """Repeats whose settled anchors are compacted into paths."""

    def paths(self, places: DataFrame, folder: str) -> DataFrame:
        """places (node, id, fp, pos) -> (node, path, far, hops): the node
        that a nonbranching path begins with, and the words and edges from
        there. Nodes that begin a path do not appear."""
        text = Window.partitionBy("id", "fp").orderBy("pos")
        steps = places.select("node", F.lead("node").over(text).alias("next"), (F.lead("pos").over(text) - F.col("pos")).alias("far"))
        steps = steps.where(F.col("far") <= self.length)
        edges = steps.groupBy("node", "next", "far").agg(F.count(F.lit(1)).alias("c"))
        n = places.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        alone = (edges.join(n, "node").where("c = n").drop("n")
                 .join(n.withColumnRenamed("node", "next"), "next").where("c = n"))
        now = stored(alone.select(F.col("next").alias("node"), F.col("node").alias("path"), "far", F.lit(1).cast("long").alias("hops")), folder, "jump0")
        i = 0
        while True:
            onward = now.select(F.col("node").alias("path"), F.col("path").alias("p2"), F.col("far").alias("f2"), F.col("hops").alias("h2"))
            both = now.join(onward, "path", "left")
            zero = F.lit(0).cast("long")
            i += 1
            new = stored(both.select("node", F.coalesce("p2", "path").alias("path"), (F.col("far") + F.coalesce("f2", zero)).alias("far"),
                                     (F.col("hops") + F.coalesce("h2", zero)).alias("hops"), F.col("p2").isNotNull().alias("moved")), folder, f"jump{i}")
            dropped(places.sparkSession, folder, f"jump{i - 1}")
            now = new.drop("moved")
            if not new.where("moved").head(1):
                return now

    def ranges(self, whole: DataFrame, folder: str) -> DataFrame:
        places = stored(whole.repartition("id", "fp").dropDuplicates(["id", "fp", "pos", "node"]), folder, "places")
        paths = self.paths(places, folder)
        zero = F.lit(0).cast("long")
        on = places.join(paths, "node", "left").select(
            "id", "fp", "pos", F.coalesce("path", "node").alias("path"), (F.col("pos") - F.coalesce("far", zero)).alias("start"), F.coalesce("hops", zero).alias("hops"))
        spans = on.groupBy("id", "fp", "path", "start").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count(F.lit(1)).alias("n"),
                                                           F.min("hops").alias("h1"), F.max("hops").alias("h2"))
        sound = F.col("n") == F.col("h2") - F.col("h1") + 1
        reach = self.length - self.k
        good = spans.where(sound).select("id", "fp", (F.col("a") - reach).alias("lo"), (F.col("b") + self.length).alias("hi"))
        rest = on.join(spans.where(~sound), ["id", "fp", "path", "start"], "left_semi").select(F.lit(0).alias("node"), "id", "fp", "pos")
        return good.union(super().ranges(rest, folder))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> the words that stay."""
    for b in batches:
        out = []
        for i, text, spans in zip(*(c.to_pylist() for c in b.columns)):
            words = text.encode().split()
            n = len(words)
            if spans:
                gone = marked(n, spans)
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            left = b" ".join(words)
            out.append((i, n, n - len(words), left.decode(), hashlib.sha256(left).hexdigest()))
        cols = list(zip(*out)) or [[]] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def dedup(df, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K):
    """Per row of df: doc_id, n_words, n_removed, kept, kept_sha256."""
    docs = documents(df, key, text)
    spans = Graph(length, k, word_values, every=True).marks(docs)
    rows = docs.join(spans, ["id", "fp"], "left").select(F.nullif("id", F.lit(LAST)).alias("doc_id"), "text", "spans")
    return on_arrow(rows, cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def op9(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents")).drop("kept")


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS s, unnest(list_transform(range(1, len(w) - 33),
    lambda s: md5(array_to_string(w[s:s + 34], ' ')))) AS k FROM d WHERE len(w) >= 35),
f AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM x) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM f),
p AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS kept FROM p ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
