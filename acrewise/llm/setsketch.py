"""Op 11, near-duplicate documents by SetSketch.

1. A document's set of word shingles is sketched by ``M`` registers. Every
   shingle is a Poisson process of rate ``RATE`` in each register; a register
   keeps the first arrival x of all shingles, truncated to floor(1 - log_b x):
   the spacing is exponential, the union of two sets has the larger registers,
   and similar sets agree in many. Documents with equal sets are one point.
2. Points that agree in a band of ``ROWS`` registers share a bucket. Each is
   compared with the first point of its buckets by the likelihood of their
   registers (which are larger, smaller and equal, given both set sizes): as
   the likelihood of the similarity has one maximum, the estimate is over
   ``LOWEST`` if the likelihood rises there. Points that are far from the first
   one are compared with all points of the bucket, in blocks, so no pair of a
   bucket is left out that could be a link.
3. Points that such pairs connect are a cluster.
4. Clusters are verified on the full sets: every text goes to the task of its
   cluster once. Points linked to the cluster's pivot are one group and are
   never compared with each other; the others are compared with all. A cluster
   of more than ``BLOCK_BYTES`` is dealt into blocks that all hold the pivot;
   then only points outside the pivot's group visit the other blocks.
5. The links' connected components are the classes.

A pair at the threshold shares no bucket with a probability of 2e-8 and is
estimated below ``LOWEST`` with 6e-8. Tasks return trees of links, never all
pairs. Copies of a text leave a map task once, and a bitmap of fixed size
(``PICK_BITS``) keeps most texts that are in no cluster from being shuffled; it
decides how much is read, never the result.

Defined cases: null and empty texts, and texts of blanks, have the empty set
and are linked with nothing; an id may be null or repeated, rows are told apart
by their texts' digests (128 bits): the class id is the smallest id of the
class, null if none has one, and a row without id is kept if its class has
none; equal rows are in one class; a very long text is one point; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrewise.llm import symbols
from acrewise.llm.common import on_arrow, partitions, scratch, stored, table
from acrewise.llm.components import components

WORDS = 3
PERCENT = 85
BANDS, ROWS = 30, 5
M = BANDS * ROWS
BASE = 1.001           # spacing of the registers
RATE = 20.0            # arrivals a shingle and register
TOP = (1 << 16) - 1    # largest register value
LOWEST = 0.66          # estimates below it are no links
BUCKET_BLOCK = 4096    # points of a bucket in one task
BLOCK_BYTES = 4 << 20  # of a cluster's sets in one task
PICK_BITS = 1 << 24


# ---- sets and registers ----------------------------------------------------

def shingles(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's shingles."""
    data, ends = symbols.text_bytes(column)
    for first, last in symbols.stretches(ends):
        values, at = symbols.word_values(data[ends[first]:ends[last]], ends[first:last + 1] - ends[first], fold=True)
        sums = symbols.prefix_sums(values)
        start = np.arange(max(len(values) - words + 1, 0))
        grams = symbols.span_hash(sums, start, start + words)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= words:
                yield np.unique(grams[a:b - words + 1])
            elif b > a:  # marked by its length, so that it equals no full shingle
                yield symbols.mixed(symbols.span_hash(sums, np.array([a]), np.array([b])) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of M register values for each set. The processes of all
    registers together have rate M * RATE: arrivals are drawn in turn from the
    shingle's hash, and each falls into a random register. They are followed
    up to a limit by which all registers should have one; sets where some have
    none get a larger limit."""
    sizes = np.array([len(g) for g in sets], np.int64)
    g, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    least = np.full(len(sets) * M, np.inf)
    limit = (np.log(M) + 3) / (RATE * np.maximum(sizes, 1))
    at, drawn = np.zeros(len(g)), np.zeros(len(g), np.uint64)
    live, few = np.arange(len(g)), 0
    late_at, late_slot = np.full(len(g), np.inf), np.zeros(len(g), np.int64)  # arrivals beyond the limit, not yet counted
    while True:
        while len(live):
            step = 1 if few < 6 else 32
            few += 1
            turn = drawn[live][:, None] + np.arange(1, step + 1, dtype=np.uint64)
            h = symbols.mixed(g[live][:, None] + turn * symbols.BASE)
            x = at[live][:, None] + np.cumsum(-np.log(((h >> np.uint64(11)) + np.uint64(1)) * 2.0 ** -53), axis=1) / (M * RATE)
            slot = (owner[live] * M)[:, None] + ((h & np.uint64(0x7FF)) * np.uint64(M) >> np.uint64(11)).astype(np.int64)
            good = x <= limit[owner[live]][:, None]
            np.minimum.at(least, slot[good], x[good])
            ended = ~good[:, -1]
            first = np.argmin(good, axis=1)
            k = np.arange(len(live))
            done = live[ended]
            late_at[done], late_slot[done] = x[k, first][ended], slot[k, first][ended]
            at[done], drawn[done] = x[k, first][ended], drawn[done] + (first[ended] + 1).astype(np.uint64)
            live = live[~ended]
            at[live], drawn[live] = x[~ended, -1], drawn[live] + np.uint64(step)
        short = np.isinf(least.reshape(-1, M)).any(axis=1) & (sizes > 0)
        if not short.any():
            break
        limit[short] *= 1.5
        live = np.flatnonzero(late_at <= limit[owner])
        np.minimum.at(least, late_slot[live], late_at[live])
        late_at[live] = np.inf
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.clip(np.floor(1 - np.log(least.reshape(-1, M)) / np.log(BASE)), 0, TOP).astype(np.uint16)


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> the digest of the text, the size and identity of its set
    (the first half of it also as a number) and its registers."""
    for b in batches:
        data, ends = symbols.text_bytes(b.column(1))
        digest = [hashlib.md5(data[x:y]).digest() for x, y in zip(ends[:-1], ends[1:])]
        n, sid, d, regs, held = [], [], [], [], []

        def flush():
            if held:
                regs.extend(r.tobytes() if len(g) else None for r, g in zip(registers(held), held))
                held.clear()
        for g in shingles(b.column(1)):
            n.append(len(g))
            sid.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None)
            d.append(int.from_bytes(sid[-1][:8], "little", signed=True) if len(g) else None)
            held.append(g)
            if sum(map(len, held[-64:])) > 1 << 17 or len(held) >= 1024:
                flush()
        flush()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(sid, pa.binary()),
                                          pa.array(d, pa.int64()), pa.array(regs, pa.binary())], ["id", "digest", "n", "sid", "d", "regs"])


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, M)


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, regs) -> (key, d), one row for each band."""
    for b in batches:
        d, regs = b.column(0).to_numpy(), matrix(b.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64) * symbols.BASE
        for k in range(ROWS):
            key = symbols.mixed(key * symbols.BASE + regs[:, :, k] + np.uint64(1))
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(d, BANDS))], ["key", "d"])


def rises(more: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray, least: float = LOWEST) -> np.ndarray:
    """Whether the likelihood of the similarity still rises at ``least``, for
    pairs of sets of n1 and n2 shingles where ``more`` registers of the first
    are larger and ``less`` are smaller."""
    u = n1 / (n1 + n2)
    v = 1 - u
    x, y = u - v * least, v - u * least  # shares of the union that are in one set alone, times 1 + J
    c = (BASE - 1) / BASE
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = -np.log1p(-c * x) / np.log(BASE), -np.log1p(-c * y) / np.log(BASE)
        dp, dq = c / (1 - c * x) / np.log(BASE), c / (1 - c * y) / np.log(BASE)
        slope = -more * v * dp / p - less * u * dq / q + (M - more - less) * (v * dp + u * dq) / (1 - p - q)
    return (x > 0) & (y > 0) & (slope > 0)  # else the sizes alone rule it out


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (d, lead, u, n, regs, v, n, regs) -> those that may be links."""
    for b in batches:
        if b.num_rows:
            one, other = matrix(b.column(4)), matrix(b.column(7))
            good = rises((one > other).sum(axis=1), (one < other).sum(axis=1), b.column(3).to_numpy(), b.column(6).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in (0, 1, 2, 5)], ["d", "lead", "u", "v"]).filter(pa.array(good))


# ---- tasks that hold one block ----------------------------------------------

class Forest:
    """Groups of labels that are found to be connected."""

    def __init__(self):
        self.up: dict = {}

    def top(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def by_block(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """Rows of sorted batches, each with whether its block is a new one."""
    last = None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            yield row[:keys] != last, row[keys:]
            last = row[:keys]


def edge_batch(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], ["u", "v"])


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, visits, sid, label, n, regs), a block's own points before
    its visitors; points that may be linked with the first point of the bucket
    have its label -> a tree of the pairs that may be links."""
    edges: list = []
    for new, (visits, sid, label, n, regs) in by_block(batches, 2):
        if new:
            own, forest, held = [], Forest(), None
            if len(edges) > 10_000:
                yield edge_batch(edges)
                edges = []
        if not visits:
            own.append((sid, label, n, regs))
            continue
        if held is None:
            held = np.frombuffer(b"".join(r for *_, r in own), np.uint16).reshape(-1, M), np.array([x[2] for x in own])
        mine = np.frombuffer(regs, np.uint16)
        good = rises((held[0] > mine).sum(axis=1), (held[0] < mine).sum(axis=1), held[1], np.full(len(own), n))
        edges += [(sid, own[k][0]) for k in np.flatnonzero(good).tolist() if forest.join(label, own[k][1])]
    if edges:
        yield edge_batch(edges)


class Block:
    """Sets of one block, to be asked which of them a set is linked with."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(g) for g in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.known, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(self.known) + 1, bool)

    def linked(self, g: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, g)
        at = np.where(self.known[np.minimum(at, len(self.known) - 1)] == g, at, len(self.known))
        self.mark[:] = False
        self.mark[at] = True
        self.mark[-1] = False
        both = np.add.reduceat(self.mark[self.codes], self.starts, dtype=np.int64)
        return 100 * both >= PERCENT * (self.sizes + len(g) - both)


def solved(sids: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """The groups that links make in a block: each point with the least of its
    group. The first set is the pivot: what is linked to it is one group, and
    all others are compared with all."""
    block, forest = Block(sets), Forest()
    near = block.linked(sets[0])
    for q in [0, *np.flatnonzero(~near).tolist()]:
        for k in np.flatnonzero(near if q == 0 else block.linked(sets[q])).tolist():
            forest.join(sids[q], sids[k])
    return [(x, forest.top(x)) for x in sids if forest.top(x) != x]


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, block, sid, text) with the pivot first -> links."""
    sids: list = []
    texts: list = []
    edges: list = []

    def ended():
        return solved(sids, list(shingles(pa.array(texts, pa.string())))) if len(sids) > 1 else []
    for new, (_, sid, text) in by_block(batches, 2):
        if new:
            edges += ended()
            sids, texts = [], []
            if len(edges) > 10_000:
                yield edge_batch(edges)
                edges = []
        if not sids or sids[-1] != sid:
            sids.append(sid)
            texts.append(text)
    edges += ended()
    if edges:
        yield edge_batch(edges)


def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, block, visits, sid, group, text), a block's own texts before
    its visitors -> the links of visitors with texts of other groups."""
    edges: list = []
    last = None
    for new, (visits, sid, group, text) in by_block(batches, 2):
        if new:
            own, forest, block = [], Forest(), None
            if len(edges) > 10_000:
                yield edge_batch(edges)
                edges = []
        if not new and (visits, sid) == last:
            continue
        last = visits, sid
        if not visits:
            own.append((sid, group, text))
            continue
        if block is None and own:
            block = Block(list(shingles(pa.array([x[2] for x in own], pa.string()))))
        if block is not None:
            (g,) = shingles(pa.array([text], pa.string()))
            edges += [(sid, own[k][0]) for k in np.flatnonzero(block.linked(g)).tolist() if forest.join(group, own[k][1])]
    if edges:
        yield edge_batch(edges)


def picked(bits: np.ndarray):
    """(text) -> (digest, text) of the texts whose bit is set, of each text in
    a task the first copy."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            data, ends = symbols.text_bytes(b.column(0))
            digest = [hashlib.md5(data[x:y]).digest() for x, y in zip(ends[:-1], ends[1:])]
            keep = []
            for k, x in enumerate(digest):
                if bits[int.from_bytes(x[:3], "big") % PICK_BITS] and x not in seen:
                    seen.add(x)
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), b.column(0)], ["digest", "text"]).take(pa.array(keep, pa.int64()))
    return run


def pick_bits(points: DataFrame) -> np.ndarray:
    """A bitmap of the digests, PICK_BITS bits whatever their number."""
    bit = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("long") % PICK_BITS + 1  # Spark's buckets begin at 1
    parts = points.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("b"))
    bits = np.zeros(PICK_BITS, bool)
    for k, b in parts.collect():  # PICK_BITS / 32768 rows at most
        some = np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")
        bits[(k - 1) * len(some):k * len(some)] = some
    return bits


# ---- the job ---------------------------------------------------------------

EDGES = "u binary, v binary"


def clusters(points: DataFrame, folder: str, n: int) -> DataFrame:
    """points (sid, d, n, regs) -> (u, root): who may be linked with whom."""
    entries = on_arrow(points.select("d", "regs"), bands, "key long, d long")
    leads = entries.groupBy("key").agg(F.min("d").alias("lead"), F.max("d").alias("last"), F.count(F.lit(1)).alias("size")).where("lead < last").drop("last")
    shared = stored(entries.join(leads, "key"), folder, "shared")
    side = lambda d, k: points.select(F.col("d").alias(d), *[F.col(c).alias(f"{c}{k}") for c in ("sid", "n", "regs")])
    pairs = shared.where("d <> lead").select("d", "lead").distinct().join(side("d", 1), "d").join(side("lead", 2), "lead")
    links = stored(on_arrow(pairs.select("d", "lead", "sid1", "n1", "regs1", "sid2", "n2", "regs2"), alike, f"d long, lead long, {EDGES}"), folder, "alike")

    # points that are far from the first of their bucket, against all of it
    # (a bucket of two is settled)
    known = links.select("d", "lead", F.lit(True).alias("linked")).distinct()
    marked = shared.where("size > 2").join(known, ["d", "lead"], "left").select(
        "key", "d", "size", (F.coalesce("linked", F.lit(False)) | (F.col("d") == F.col("lead"))).alias("near"), "lead")
    far = marked.where("NOT near")
    open_ = far.select("key").distinct()
    blocks = F.ceil(F.col("size") / BUCKET_BLOCK).cast("int")
    label = F.when(F.col("near"), F.col("lead")).otherwise(F.col("d")).alias("label")
    own = marked.join(open_, "key", "left_semi").select("key", F.pmod(F.xxhash64("d"), blocks).cast("int").alias("block"), F.lit(0).alias("visits"), "d", label)
    guests = far.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("visits"), "d", label)
    rows = own.union(guests).join(points.select("d", "sid", "n", "regs"), "d").select("key", "block", "visits", "sid", "label", "n", "regs")
    more = on_arrow(rows.repartition(n, "key", "block").sortWithinPartitions("key", "block", "visits", "sid"), bucket_links, EDGES)
    return components(links.select("u", "v").union(stored(more, folder, "more")))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of df."""
    spark = df.sparkSession
    folder, n = scratch(spark), partitions(spark)
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    base = stored(on_arrow(docs, sketch, "id long, digest binary, n long, sid binary, d long, regs binary"), folder, "base")
    points = base.where("n > 0").groupBy("sid").agg(F.min("digest").alias("digest"), *[F.first(c).alias(c) for c in ("d", "n", "regs")])
    points = stored(points, folder, "points")
    cluster = stored(clusters(points, folder, n).select(F.col("u").alias("sid"), F.col("root").alias("cluster")), folder, "clusters")
    cluster = cluster.union(cluster.select(F.col("cluster").alias("sid"), "cluster")).distinct()

    part = cluster.join(points.select("sid", "digest", "n"), "sid")
    sizes = part.groupBy("cluster").agg(F.ceil(F.sum(8 * F.col("n")) / BLOCK_BYTES).cast("int").alias("blocks"))
    part = part.join(sizes, "cluster").select("cluster", "sid", "digest", "blocks", F.pmod(F.xxhash64("sid"), "blocks").cast("int").alias("own"))
    part = stored(part, folder, "part")
    texts = on_arrow(docs.select("text"), picked(pick_bits(part)), "digest binary, text string")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    tasks = part.select("cluster", F.explode(F.when(F.col("sid") == F.col("cluster"), every).otherwise(F.array("own"))).alias("block"),
                        (F.col("sid") != F.col("cluster")).alias("later"), "sid", "digest")
    rows = tasks.join(texts, "digest").select("cluster", "block", "later", "sid", "text")
    links = stored(on_arrow(rows.repartition(n, "cluster", "block").sortWithinPartitions("cluster", "block", "later", "sid"), verified, EDGES), folder, "links")
    split = part.where("blocks > 1")
    if not split.isEmpty():
        # the points outside the pivot's group visit the other blocks
        split = split.join(links, F.col("sid") == F.col("u"), "left").withColumn("grp", F.coalesce("v", "sid"))
        split = stored(split.drop("u", "v"), folder, "split")
        own = split.select("cluster", F.col("own").alias("block"), F.lit(0).alias("visits"), "sid", "grp", "digest")
        guests = split.where("grp <> cluster").select("cluster", F.explode(every).alias("block"), F.lit(1).alias("visits"), "sid", "grp", "digest")
        rows = own.union(guests).join(texts, "digest").select("cluster", "block", "visits", "sid", "grp", "text")
        more = on_arrow(rows.repartition(n, "cluster", "block").sortWithinPartitions("cluster", "block", "visits", "sid"), visited, EDGES)
        links = links.union(stored(more, folder, "visits"))
    roots = components(links)

    labels = base.select("id", "n", "sid").join(roots, F.col("sid") == F.col("u"), "left").select("id", "n", F.coalesce("root", "sid").alias("class"))
    least = stored(labels.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("least")), folder, "least")
    return labels.join(least, "class", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def op11(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: md5(array_to_string(w[i:i + {WORDS - 1}], ' ')))
    WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS g FROM w),
g AS (SELECT rid, len(g) AS n, unnest(g) AS h FROM s),
l AS (SELECT a.rid AS u, b.rid AS v FROM g a JOIN g b ON a.h = b.h AND a.rid <> b.rid GROUP BY a.rid, b.rid, a.n, b.n
  HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
r AS (SELECT rid AS u, doc_id AS m FROM s UNION SELECT l.v, r.m FROM r JOIN l ON l.u = r.u WHERE r.m IS NOT NULL),
c AS (SELECT u, min(m) AS m FROM r GROUP BY u)
SELECT doc_id, len(g) AS n_shingles, m AS component_id, doc_id IS NOT DISTINCT FROM m AS kept FROM s JOIN c ON c.u = rid"""
