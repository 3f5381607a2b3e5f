"""Op 12, audit of how far a language's sources diverge in their words.

1. Counting by token-start pointer sort. A slice of an Arrow text buffer gives
   one pointer for each term start; the pointers, not the terms, are sorted by
   a multikey quicksort (eight bytes of the term at a time, only runs that are
   equal so far go on to the next eight). An equal run is a term: its length
   is the count, its changes of document the document frequency, its stretches
   of one source the counts by source.
2. The runs of all slices meet by (language, term); terms in fewer than
   ``MIN_DOCS`` documents of the language go.
3. Smoothed shares p in parts of ``SCALE`` for every source and language, and
   the divergence f = floor((p - q)**2 / q) of a source from the others
   (summed over all kept terms, blocks of terms at a time) and from its
   language (by term).

All arithmetic is in whole numbers. A slice sends one row for each term and
language, so a frequent term costs a row a slice; blocks of terms are dealt by
hash, so a language with a third of the terms is many blocks. A block holds
its terms by all sources of the language: the pair part has one row for each
pair of sources anyway.

Defined cases: null text, language and source are read as ''; empty texts have
no terms but their group counts; each row is a document (repeated rows count
each time, null ids too: ids are not read); a text longer than a slice is cut
between terms and its slices are put together before it counts as a document;
an empty table gives an empty result; columns other than the three are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrewise.llm import symbols
from acrewise.llm.common import on_arrow, partitions, scratch, stored, table

MIN_DOCS = 3
SCALE = 1_000_000_000
RANKS = 200
SLICE = 16 << 20   # bytes of text whose pointers are sorted at once
BLOCK = 20_000     # terms of a language that are compared at once

LETTER = np.zeros(256, bool)  # bytes of a term: A-Z, a-z and all beyond ASCII
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
MASK = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], np.uint64)


# ---- pointers --------------------------------------------------------------

def pointers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every term of a text."""
    inside = LETTER[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def pointer_sort(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the pointers by the bytes of their terms: their
    order (equal terms stay in the order given), and which begin a run."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))
    order, new = np.arange(len(start)), np.zeros(len(start), bool)
    at, group, depth = np.arange(len(start)), None, 0
    while len(at):
        p = order[at]
        left = np.clip(size[p] - depth, 0, 8)
        key = eight[np.where(left > 0, start[p] + depth, 0)].astype(np.uint64) & MASK[left]
        o = np.argsort(key, kind="stable") if group is None else np.lexsort((key, group))
        order[at], key = p[o], key[o]
        first = np.append(True, key[1:] != key[:-1])
        if group is not None:
            first[1:] |= group[o][1:] != group[o][:-1]
        new[at] |= first
        run = np.cumsum(first) - 1
        longer = size[order[at]] > depth + 8
        on = (np.bincount(run, longer) > 0) & (np.bincount(run) > 1)
        at, group, depth = at[on[run]], run[on[run]], depth + 8
    return order, new


def spelled(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The terms at these pointers."""
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())


def runs(data: np.ndarray, start: np.ndarray, size: np.ndarray, lang: np.ndarray, code: np.ndarray, doc: np.ndarray) -> tuple:
    """Pointers with their language, source and document (numbers) -> for each
    (language, term): a pointer and its documents; for each source of it the
    row that it belongs to, the source and the count."""
    o = np.lexsort((doc, code, lang))
    order, new = pointer_sort(data, start[o], size[o])
    order = o[order]
    lang, code, doc = lang[order], code[order], doc[order]
    change = lambda x: np.append(True, x[1:] != x[:-1])
    new |= change(lang)                      # a row
    part = new | change(code)                # one source of it
    row = np.cumsum(new) - 1
    docs = np.bincount(row, part | change(doc)).astype(np.int64)
    at = np.flatnonzero(part)
    return order[new], lang[new], docs, row[at], code[at], np.diff(np.append(at, len(order)))


def batch_of(terms: pa.Array, langs: pa.Array, docs: np.ndarray, row: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.searchsorted(row, np.arange(len(docs) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (code.astype(np.int32), n.astype(np.int64))]
    return pa.RecordBatch.from_arrays([langs, terms, pa.array(docs), *lists], ["lang", "term", "docs", "codes", "counts"])


def long_text(data: np.ndarray, code: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """Terms and counts of one text of more than a slice."""
    found: dict[bytes, int] = {}
    at = 0
    while at < len(data):
        to = min(at + SLICE, len(data))
        while to < len(data) and LETTER[data[to]] and LETTER[data[to - 1]]:
            to += 1
        piece = symbols.FOLD[data[at:to]]
        start, size = pointers(piece)
        if len(start):
            order, new = pointer_sort(piece, start, size)
            first = np.flatnonzero(new)
            for p, n in zip(order[first].tolist(), np.diff(np.append(first, len(order))).tolist()):
                term = piece[start[p]:start[p] + size[p]].tobytes()
                found[term] = found.get(term, 0) + n
        at = to
    names = list(found)
    for k in range(0, len(names), 100_000):
        some = names[k:k + 100_000]
        yield some, [found[x] for x in some]


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, text) -> (lang, term, docs, codes, counts), one row for
    each term and language of a slice."""
    for b in batches:
        names = b.column(0).dictionary_encode()
        lang, code = names.indices.to_numpy(), b.column(1).to_numpy()
        data, ends = symbols.text_bytes(b.column(2))
        for first, last in symbols.stretches(ends, SLICE):
            piece = data[ends[first]:ends[last]]
            if len(piece) > SLICE and last == first + 1:
                for terms, n in long_text(piece, code[first]):
                    k = np.arange(len(terms))
                    yield batch_of(pa.array(terms, pa.binary()).cast(pa.string()), pa.array([names.dictionary[lang[first]].as_py()] * len(terms), pa.string()),
                                   np.ones(len(terms), np.int64), k, np.full(len(terms), code[first]), np.array(n))
                continue
            # a blank between the texts, so that no term reaches into the next one
            at = ends[first:last + 1] - ends[first]
            text = np.insert(symbols.FOLD[piece], at[1:-1], 32)
            at = at + np.concatenate([np.arange(last - first), [last - first - 1]])
            start, size = pointers(text)
            if not len(start):
                continue
            doc = np.searchsorted(at, start, "right") - 1
            pointer, langs, docs, row, codes, n = runs(text, start, size, lang[first + doc], code[first + doc], doc)
            yield batch_of(spelled(text, start[pointer], size[pointer]), names.dictionary.take(pa.array(langs)), docs, row, codes, n)


# ---- terms -----------------------------------------------------------------

def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``count`` sorted by (lang, term) -> kept terms with the counts
    of their sources. Holds the counts of one term."""
    key, docs, counts = None, 0, {}
    out: list[tuple] = []

    def packed():
        cols = [list(c) for c in zip(*out)]
        out.clear()
        types = (pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["lang", "term", "codes", "counts"])
    for b in batches:
        for lang, term, d, cs, ns in zip(*(c.to_pylist() for c in b.columns)):
            if (lang, term) != key:
                if docs >= MIN_DOCS:
                    out.append((*key, list(counts), list(counts.values())))
                    if len(out) >= 20_000:
                        yield packed()
                key, docs, counts = (lang, term), 0, {}
            docs += d
            for c, n in zip(cs, ns):
                counts[c] = counts.get(c, 0) + n
    if docs >= MIN_DOCS:
        out.append((*key, list(counts), list(counts.values())))
    if out:
        yield packed()


def parts(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total) without leaving 64 bits (counts
    up to 9e13): the division is done in two steps."""
    a, rest = np.divmod((count + 1) * 100_000, total)
    return 1 + a * (SCALE // 100_000) + rest * (SCALE // 100_000) // total


def compare(key: tuple, terms: pa.Table, totals: pa.Table) -> pa.Table:
    """One block of a language's terms -> f summed for each pair of sources
    with a term in the block or not. ``totals``: one row with N + V by source."""
    whole = np.array(totals["totals"][0].as_py(), np.int64)
    lists = terms["codes"].combine_chunks()
    count = np.zeros((len(terms), len(whole)), np.int64)
    row = np.repeat(np.arange(len(terms)), np.diff(lists.offsets.to_numpy()))
    count[row, lists.values.to_numpy()] = terms["counts"].combine_chunks().values.to_numpy()
    p = parts(count, whole)
    found = []
    for a in range(len(whole)):
        f = (p[:, a:a + 1] - p) ** 2 // p
        found.append(f.sum(axis=0))
    n = len(whole)
    a, b = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    return pa.table({"lang": pa.array([key[0].as_py()] * (n * n), pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()),
                     "f": pa.array(np.concatenate(found) if found else [], pa.int64())}).filter(pa.array(a != b))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    spark = df.sparkSession
    folder, n = scratch(spark), partitions(spark)
    docs = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))])
    # one row for each source; a language's sources are numbered from 0
    groups = docs.select("lang", "source").distinct()
    groups = groups.withColumn("code", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = stored(groups, folder, "groups")
    coded = docs.join(groups, ["lang", "source"]).select("lang", "code", "text")
    counted = on_arrow(coded, count, "lang string, term string, docs long, codes array<int>, counts array<long>")
    kept = on_arrow(counted.repartition(n, "lang", "term").sortWithinPartitions("lang", "term"), merge,
                    "lang string, term string, codes array<int>, counts array<long>")
    kept = stored(kept, folder, "kept")

    flat = kept.select("lang", "term", F.explode(F.arrays_zip("codes", "counts")).alias("x")).select("lang", "term", F.col("x.codes").alias("code"), F.col("x.counts").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = flat.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    known = groups.join(by_lang, "lang").join(sums, ["lang", "code"], "left").select(
        "lang", "source", "code", "v", F.coalesce("n", F.lit(0)).alias("n"))
    known = stored(known.withColumn("all", F.sum("n").over(Window.partitionBy("lang"))), folder, "known")

    # pairs of sources: blocks of terms beside the totals of all sources
    block = kept.join(by_lang, "lang").select("lang", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / BLOCK)).cast("int").alias("block"), "codes", "counts")
    totals = (known.groupBy("lang").agg(F.first("v").alias("v"), F.array_sort(F.collect_list(F.struct("code", (F.col("n") + F.col("v")).alias("t")))).alias("t"))
              .select("lang", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("v") / BLOCK) - 1).cast("int"))).alias("block"), F.col("t.t").alias("totals")))
    sums = (block.groupBy("lang", "block").cogroup(totals.groupBy("lang", "block"))
            .applyInArrow(compare, "lang string, a int, b int, f long").groupBy("lang", "a", "b").agg(F.sum("f").alias("f")))
    one, other = groups.select("lang", "source", F.col("code").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("code").alias("b"))
    pairs = one.join(other, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).alias("value"))
             .withColumn("rank", F.row_number().over(order)))

    # terms of a source that its language has fewer of
    share = lambda c, total: f"1 + CAST({SCALE} AS DECIMAL(38,0)) * CAST({c} + 1 AS DECIMAL(20,0)) div CAST({total} AS DECIMAL(20,0))"
    every = kept.select(
        "lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("m"), F.explode(F.arrays_zip("codes", "counts")).alias("x"))
    both = (every.select("lang", "term", "m", F.col("x.codes").alias("code"), F.col("x.counts").alias("c")).join(known, ["lang", "code"])
            .selectExpr("lang", "source", "term", f"{share('c', 'n + v')} AS p", f"{share('m', '`all` + v')} AS q").where("p > q"))
    terms = (both.selectExpr("lang", "source", "'term' AS part", "term AS item", "(p - q) * (p - q) div q AS value")
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS))
    return pairs.union(terms)


def op12(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS m FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(m) AS HUGEINT) AS alln FROM k GROUP BY lang),
s AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + l.v) AS p,
    1 + CAST({SCALE} AS HUGEINT) * (k.m + 1) // (l.alln + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS f
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.f, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= {RANKS}"""
