"""Op 4, exact join of documents by Jaccard similarity of their word n-grams,
as a join in the metric space of the Jaccard distance d = 1 - J.

1. Documents with equal n-gram sets are one point.
2. Pivots and regions. Points whose sets share minimum hashes elect one of
   them (the smallest) as pivot; a point belongs to the region of the pivot
   that it shares most of them with, or is the pivot of its own region. Every
   point has exactly one home region.
3. Boundary replication. A point must visit a foreign region if a member of
   it may lie within the join distance r. Such a pair shares an n-gram in the
   first n - ceil((1 - r) n) + 1 ones of both sets, under any common order of
   all n-grams. Half as many again are taken by hash, and of these the rare
   ones first. The sets' windows of hashes differ, so this is not one order
   of all n-grams: a close pair shares a rare n-gram within both windows, and
   the first such one is in both prefixes with only unshared rare ones before
   it; or it shares none there, and then its first shared frequent n-gram is
   in both prefixes (the longer window holds too few others to push it out)
   with only unshared n-grams of smaller hash. So the sizes, and the rare
   position of a rare n-gram or the hash position of a frequent one, bound
   the distance further. One of the two visits the other's region, so
   every close pair meets in some region. An n-gram that more than ``LIST``
   points hold spans too many regions for that. These points, the crowd, are
   few, as a frequent n-gram is in a prefix only where the smallest hashes hold
   little else; close pairs that are bound to meet by such an n-gram have both
   points among them. So their whole sets are read: by one common order of all
   n-grams, those that few points of the crowd hold first, they get prefixes
   anew, and most meet nobody any more. Where even such a prefix has an n-gram
   of more than ``LIST`` points, the sets hold little that is not frequent:
   sorted by size, neighbours that may be close join their regions, a row for
   each of them.
4. Regions join exactly: the points linked to a region's pivot are one group
   and are never compared with each other, so a group of near copies costs its
   size, not its square; by the triangle inequality a point at distance a from
   the pivot is compared only with points at a - r to a + r. A region of more
   than ``REGION_BYTES`` is dealt into blocks that all hold the pivot; then the
   points outside its largest group, and they alone, visit the other blocks. A
   task returns a tree for each group it finds, never all pairs.
5. The trees' connected components are the classes.

The frequency order is a bitmap of fixed size (``HOT_BITS``) of the hashes
that many points share, and another one (``SHARED_BITS``) tells most n-grams
that a single point has; they decide how much work there is, never the result.

Defined cases: null and empty texts, and texts of blanks, have the empty set
and are linked with nothing; null ids never become a class id unless all ids
of the class are null; equal rows are in one class; very long texts are one
point; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrewise.llm import symbols
from acrewise.llm.common import dropped, flagged, freed, has_bit, in_files, low_bits, names, numbered, on_arrow, partitions, picked, scratch, stored, table
from acrewise.llm.components import components
from acrewise.llm.repeats import LAST, documents
from acrewise.llm.setsketch import Forest, by_block, edge_batch

WORDS = 4
PERCENT = 85
BINS = 8               # minimum hashes of a point
AGREE = 2              # of them, shared with a pivot to enter its region
HOT_LIST = 32          # points that share an n-gram from which it counts as frequent
HOT_BITS = 1 << 22
SHARED_BITS = 1 << 26
LIST = 64              # points with a common n-gram that are tested in pairs
LEVELS = (2, 8, 64, 512)  # points of the crowd that share an n-gram, by which its n-grams are ordered
LEVEL_BITS = 1 << 24
REGION_BYTES = 4 << 20


def visit_batch(d: np.ndarray, region: np.ndarray, merge: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(region), pa.array(np.full(len(d), merge))], ["d", "region", "merge"])


class Holders:
    """Which of some sets hold which n-gram."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(g) for g in sets])
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        self.owner, grams = np.repeat(np.arange(len(sets)), self.sizes)[order], grams[order]
        starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        self.known, self.starts = grams[starts], np.append(starts, len(grams))

    def shared(self, g: np.ndarray) -> np.ndarray:
        """n-grams that each of the sets has in common with g: only the rows
        of its n-grams are looked at, not all of the sets."""
        at = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
        at = at[self.known[at] == g]
        start, many = self.starts[at], self.starts[at + 1] - self.starts[at]
        rows = np.arange(many.sum()) + np.repeat(start - np.cumsum(many) + many, many)
        return np.bincount(self.owner[rows], minlength=len(self.sizes))


@dataclass(frozen=True)
class Join:
    words: int = WORDS
    percent: int = PERCENT

    # ---- sets ----------------------------------------------------------

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The sorted hashes of the n-grams of each text."""
        data, offsets = symbols.text_bytes(column)
        for rows, to in symbols.stretches(offsets):
            part = data[offsets[rows]:offsets[to]]
            values, at = symbols.word_values(part, offsets[rows:to + 1] - offsets[rows], fold=True)
            s = symbols.prefix_sums(values)
            start = np.arange(max(len(values) - self.words + 1, 0))
            grams = symbols.span_hash(s, start, start + self.words)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a >= self.words:
                    g = np.sort(grams[a:b - self.words + 1])
                    yield g[np.append(True, g[1:] != g[:-1])]
                elif b > a:
                    yield symbols.span_hash(s, np.array([a]), np.array([b])) ^ np.uint64(b - a)
                else:
                    yield np.zeros(0, np.uint64)

    def prefix(self, n: int) -> int:
        """n-grams of a set of n that hold one of any close partner."""
        return n - -(-self.percent * n // 100) + 1

    def sketch(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, fp, text) -> size, identity, minimum hashes and the smallest
        hashes (half as many again as the prefix needs)."""
        for b in batches:
            sid, n, mins, low = [], [], [], []
            for g in self.sets(b.column(2)):
                n.append(len(g))
                sid.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None)
                # one minimum for each value of the low bits
                bins, first = np.unique(g & np.uint64(BINS - 1), return_index=True)
                mins.append(g[first].view(np.int64))
                low.append(g[:-(-3 * self.prefix(len(g)) // 2)].view(np.int64) if len(g) else g.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sid, pa.binary()),
                 pa.array([int.from_bytes(x[:8], "little", signed=True) if x else None for x in sid], pa.int64()),
                 pa.array(mins, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))],
                ["id", "fp", "n", "sid", "d", "mins", "low"])

    # ---- candidates ----------------------------------------------------

    def entries(self, hot: np.ndarray, shared: np.ndarray | None = None):
        """(d, region, n, low) -> the prefix of each point, rare n-grams
        first, without those that no other point has: (s, d, region, place) with place = n << 32 | position. The
        position is the number of n-grams that two points cannot share if
        this is the first that they do: the rare ones before a rare n-gram,
        and all of smaller hash before a frequent one (the rare ones of
        larger hash may be shared beyond the other point's ``low``)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d, region, n = (b.column(k).to_numpy() for k in range(3))
                keep, size, place = [], [], []
                for k, low in enumerate(b.column(3).to_pylist()):
                    g = np.array(low, np.int64)
                    often = hot[g & (HOT_BITS - 1)]
                    order = np.argsort(often, kind="stable")[:self.prefix(int(n[k]))]
                    at = (n[k] << 32) + np.where(often[order], order, np.arange(len(order)))
                    some = has_bit(shared, g[order]) if shared is not None else slice(None)
                    keep.append(g[order][some])
                    size.append(len(keep[-1]))
                    place.append(at[some])
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(keep), np.repeat(d, size), np.repeat(region, size), np.concatenate(place))],
                                                     ["s", "d", "region", "place"])
        return run

    def may_link(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether two points can be close if the n-gram at these places is
        the first that they share."""
        n1, n2 = p >> 32, q >> 32
        most = np.minimum(n1 - (p & 0xFFFFFFFF), n2 - (q & 0xFFFFFFFF))
        return most * (100 + self.percent) >= self.percent * (n1 + n2)

    def whole_entries(self, levels: list[np.ndarray]):
        """(d, region, text) -> as ``entries``, the prefix of the whole set
        under one order of all n-grams: by the bitmaps that hold them, then by
        hash. Those that no other point has are in none."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
                d, region = (b.column(k).to_numpy() for k in range(2))
                keep, place = [], []
                for g in self.sets(b.column(2)):
                    g = g.view(np.int64)
                    level = np.sum([has_bit(x, g) for x in levels], axis=0)
                    order = np.lexsort((g, level))[:self.prefix(len(g))]
                    some = np.flatnonzero(level[order])
                    keep.append(g[order][some])
                    place.append((len(g) << 32) + some)
                size = [len(x) for x in keep]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(keep), np.repeat(d, size), np.repeat(region, size), np.concatenate(place))],
                                                 ["s", "d", "region", "place"])
        return run

    def holders(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text) -> the n-grams of some texts and how many hold each: (s, c)."""
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            s, c = np.unique(np.concatenate(list(self.sets(b.column(0)))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(c, pa.int64())], ["s", "c"])

    def meet(self, batches: Iterator[pa.RecordBatch], long_lists=None) -> Iterator[pa.RecordBatch]:
        """Entries sorted by n-gram and place -> (d, region, merge): who must
        visit which region, and (merge) what ``long_lists`` (``merges``) makes
        of n-grams of more than ``LIST`` entries. Holds ``LIST`` entries of
        one n-gram and a batch."""
        long_lists = long_lists or self.merges
        held, long = None, False  # the n-gram that goes on; whether it had more than LIST entries before
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            s = cols[0]
            if not len(s):
                continue
            new = np.append(True, s[1:] != s[:-1])
            run = np.cumsum(new) - 1
            many = np.bincount(run) > LIST
            many[0] |= long
            last = run == run[-1]
            long = bool(many[-1])
            yield from long_lists([c[many[run]] for c in cols])
            yield from self.visits([c[~many[run] & ~last] for c in cols])
            held = [c[last][-1:] if long else c[last] for c in cols]
        if held is not None and not long:
            yield from self.visits(held)

    def crowd(self, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The points of long lists."""
        if len(cols[0]):
            d = np.unique(cols[1])
            yield visit_batch(d, d, True)

    def merges(self, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Entries of long lists, by size: neighbours whose sizes allow a link
        are brought together (their regions are d and region). Points that may
        be close are at most a chain of such steps apart, as the sizes between
        theirs are no further apart."""
        s, _, region, place = cols
        n = place >> 32
        at = np.flatnonzero((s[1:] == s[:-1]) & (region[1:] != region[:-1]) & (100 * n[:-1] >= self.percent * n[1:]))
        if len(at):
            two = np.unique(np.sort(np.stack([region[at], region[at + 1]]), axis=0), axis=1)
            yield visit_batch(two[1], two[0], True)

    def visits(self, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(cols[0]) < 2:
            return
        order = np.lexsort((cols[1], cols[2], cols[0]))
        s, d, region, place = (c[order] for c in cols)
        found = []
        size = 0
        new = np.append(True, s[1:] != s[:-1])
        run = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new)[1:], len(s))[run]
        # rows of one region within a list: their pairs are met at home
        block = np.append(True, new[1:] | (region[1:] != region[:-1]))
        left = np.append(np.flatnonzero(block)[1:], len(s))[np.cumsum(block) - 1]
        i = np.flatnonzero(left < ends)  # rows with other regions behind them
        j = left[i]
        while len(i):
            ok = self.may_link(place[i], place[j])
            x, y = i[ok], j[ok]
            if len(x):
                # a point alone in its region goes to the other's
                go = np.where((region[x] == d[x]) | (region[y] != d[y]), x, y)
                to = np.where(go == x, y, x)
                found.append(np.unique(np.stack([d[go], region[to]]), axis=1))
                size += found[-1].shape[1]
            j = j + 1
            more = j < ends[i]
            i, j = i[more], j[more]
            if found and (size > 200_000 or not len(i)):
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                yield visit_batch(*pairs, False)
                found, size = [], 0

    # ---- regions -------------------------------------------------------

    def solve(self, sets: list[np.ndarray]) -> np.ndarray:
        """Links within a region: for each point the least point of its group."""
        root, held = np.arange(len(sets)), Holders(sets)
        sizes = held.sizes
        both = held.shared(sets[0])
        near = (100 + self.percent) * both >= self.percent * (sizes + sizes[0])
        root[near] = 0
        # points near the pivot are one group; those too far from it to be
        # close to any of them need not be compared with them
        window, r = 1 - both / (sizes + sizes[0] - both), 1 - self.percent / 100 + 1e-9
        # a point with nobody in its window is done
        order = np.sort(window)
        lone = (np.searchsorted(order, window + r, "right") - np.searchsorted(order, window - r, "left")) <= 1
        for q in np.flatnonzero(~near & ~lone).tolist():
            close = (100 + self.percent) * held.shared(sets[q]) >= self.percent * (sizes + sizes[q])
            group = np.unique(root[close])
            if len(group) > 1:
                root[np.isin(root, group)] = group[0]
                if not root.any():
                    break
        return root

    def join_regions(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(region, block, later, sid, text), the pivot first -> (u, v) edges
        of the groups' trees. Texts travel, not their sets: 8 bytes a word of
        hashes do not compress."""
        key, sids, sets = None, [], []

        def flush():
            if len(sets) < 2:
                return None
            root = self.solve(sets)
            at = np.flatnonzero(root != np.arange(len(sets)))
            return pa.RecordBatch.from_arrays([pa.array([sids[k] for k in at], pa.binary()), pa.array([sids[root[k]] for k in at], pa.binary())], ["u", "v"])
        for k, sid, g in ((k, sid, g) for b in batches for at in range(0, b.num_rows, 256) for some in [b.slice(at, 256)]
                          for k, sid, g in zip(zip(*(some.column(c).to_pylist() for c in range(2))), some.column(3).to_pylist(), self.sets(some.column(4)))):
            if k != key:
                out = flush()
                if out is not None and out.num_rows:
                    yield out
                key, sids, sets = k, [], []
            if not sids or sids[-1] != sid:
                sids.append(sid)
                sets.append(g)
        out = flush()
        if out is not None and out.num_rows:
            yield out

    def join_visitors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(region, block, visits, sid, grp, text), a block's own points
        before its visitors -> links of visitors with points of other groups."""
        edges: list = []
        for new, (visits, sid, grp, text) in by_block(batches, 2):
            g = next(self.sets(pa.array([text], pa.string())))
            if new:
                own, forest, block = [], Forest(), None
                if len(edges) > 10_000:
                    yield edge_batch(edges)
                    edges = []
            if not visits:
                own.append((sid, grp, g))
                continue
            if not own:
                continue
            if block is None:
                block = Holders([x[2] for x in own])
            close = (100 + self.percent) * block.shared(g) >= self.percent * (block.sizes + len(g))
            edges += [(sid, own[k][0]) for k in np.flatnonzero(close).tolist() if forest.join(grp, own[k][1])]
        if edges:
            yield edge_batch(edges)

    # ---- the job -------------------------------------------------------

    def classes(self, df: DataFrame, key: str = "doc_id", text: str = "text", number: str | None = None) -> DataFrame:
        """Per row of df: k (id and number of the document), n_shingles, component_id."""
        spark = df.sparkSession
        folder, n = scratch(spark), partitions(spark)
        docs = documents(df, key, text, number)
        base = stored(on_arrow(docs, self.sketch, "id long, fp long, n long, sid binary, d long, mins array<long>, low array<long>"), folder, "sketch")
        points, size = base.where("n > 0"), base.count()

        # one document a point, and a few more where the bitmap errs
        both = F.struct("id", "fp")
        points = picked(points, both, points.groupBy("d").agg(F.min(both).alias("r")), F.col("r"), folder, "points-bits")

        # pivots: of the points that share a minimum hash, the smallest
        shared = points.select("d", F.explode("mins").alias("m")).distinct()
        pivots = shared.groupBy("m").agg(F.min("d").alias("pivot"), F.max("d").alias("last")).where("pivot < last").drop("last")
        votes = shared.join(pivots, "m").groupBy("d", "pivot").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= AGREE)
        homes = votes.groupBy("d").agg(F.max(F.struct("c", "pivot"))["pivot"].alias("region"))
        homes = stored(in_files(homes.where("d <> region"), size), folder, "homes")

        # the n-grams of several points among those that prefixes are taken from
        counts = stored(points.select(F.explode("low").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), folder, "shared")
        hot = np.unpackbits(low_bits(counts.where(F.col("c") >= HOT_LIST), "s", HOT_BITS), bitorder="little").view(bool)
        several = low_bits(counts, "s", SHARED_BITS)

        placed = points.join(homes, "d", "left").select("d", F.coalesce("region", "d").alias("region"), "n", "low")
        entries = on_arrow(placed, self.entries(hot, several), "s long, d long, region long, place long")
        visits = on_arrow(entries.repartition(n, "s").sortWithinPartitions("s", "place", "region", "d"), lambda x: self.meet(x, self.crowd), "d long, region long, merge boolean")
        visits = stored(visits.distinct(), folder, "visits")
        # only the narrow columns are read from here on
        base = stored(base.select("id", "fp", "n", "sid", "d"), folder, "points")
        points = base.where("n > 0")
        dropped(spark, folder, "sketch")
        freed(spark)
        ids = points.groupBy("d", "sid", "n").agg(F.min(both).alias("r"))

        crowd = visits.where("merge").select("d").distinct()
        visits = visits.where("NOT merge")
        if not crowd.isEmpty():
            # the crowd's whole sets, ordered by how many of its points hold an n-gram
            part = crowd.join(ids, "d").join(homes, "d", "left").select("d", F.coalesce("region", "d").alias("region"), "r.*")
            part = stored(in_files(part, size), folder, "crowd")
            texts = picked(docs, both, part, both, folder, "crowd-bits").join(part, ["id", "fp"])
            texts = stored(texts.dropDuplicates(["id", "fp"]).select("d", "region", "text"), folder, "crowd-texts")
            grams = on_arrow(texts.select("text"), self.holders, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where("c > 1")
            grams = stored(grams, folder, "crowd-grams")
            levels = [low_bits(grams.where(F.col("c") >= c), "s", LEVEL_BITS) for c in LEVELS]
            entries = on_arrow(texts, self.whole_entries(levels), "s long, d long, region long, place long")
            more = on_arrow(entries.repartition(n, "s").sortWithinPartitions("s", "place", "region", "d"), self.meet, "d long, region long, merge boolean")
            visits = visits.union(stored(in_files(more.distinct(), size), folder, "crowd-visits"))
        placings = size + visits.count()

        merges = visits.where("merge").select(F.col("d").alias("u"), F.col("region").alias("v"))
        visits = visits.where("NOT merge").drop("merge")
        active = homes.select("region").union(visits.select("region")).union(merges.select("u")).union(merges.select("v")).distinct()
        members = homes.union(visits).union(active.select(F.col("region").alias("d"), "region"))
        if not merges.isEmpty():
            whole = components(merges)
            members = members.join(whole, F.col("region") == F.col("u"), "left").select("d", F.coalesce("root", "region").alias("region"))
        members = stored(in_files(members.distinct(), placings), folder, "members")

        # regions beyond REGION_BYTES in blocks, each with the region's pivot
        placed = members.join(ids, "d")
        sized = placed.groupBy("region").agg(F.ceil(F.sum(8 * F.col("n")) / REGION_BYTES).cast("int").alias("blocks"), F.min("sid").alias("pivot"))
        placed = placed.join(sized, "region").select("region", "sid", "r", "blocks", (F.col("sid") != F.col("pivot")).alias("later"),
                                                     F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("own"))
        placed = stored(in_files(placed, placings), folder, "placed")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)

        def sent(tasks: DataFrame, name: str, many: int) -> DataFrame:
            """(sid, r, region, block, ...), about ``many`` -> with the texts in place of r."""
            cols = [c for c in tasks.columns if c not in ("sid", "r")]
            part = tasks.groupBy("sid", "r").agg(F.collect_list(F.struct(*cols)).alias("tasks"))
            part = stored(in_files(part.select("sid", "r.*", "tasks"), many), folder, name)
            freed(spark)
            texts = picked(docs, both, part, both, folder, f"{name}-bits")
            rows = part.join(texts, ["id", "fp"]).select("sid", "text", F.explode("tasks").alias("t")).select("t.*", "sid", "text")
            return rows.repartition(n, "region", "block")
        first = placed.select("sid", "r", "region", F.explode(F.when(F.col("later"), F.array("own")).otherwise(every)).alias("block"), "later")
        rows = sent(first, "part", placings).select("region", "block", "later", "sid", "text")
        trees = stored(on_arrow(rows.sortWithinPartitions("region", "block", "later", "sid"), self.join_regions, "u binary, v binary"), folder, "trees")
        freed(spark)
        roots = components(trees)

        split = placed.where("blocks > 1")
        if not split.isEmpty():
            # the points outside their region's largest group visit its blocks
            split = split.join(roots, F.col("sid") == F.col("u"), "left").withColumn("grp", F.coalesce("root", "sid"))
            main = (split.groupBy("region", "grp").agg(F.count(F.lit(1)).alias("c")).groupBy("region")
                    .agg(F.max(F.struct("c", "grp"))["grp"].alias("main")))
            split = stored(split.join(main, "region").drop("u", "root"), folder, "split")
            own = split.select("sid", "r", "region", F.col("own").alias("block"), F.lit(0).alias("visits"), "grp")
            guests = split.where("grp <> main").select("sid", "r", "region", F.explode(every).alias("block"), F.lit(1).alias("visits"), "grp")
            rows = sent(own.union(guests), "visitors", own.count() + guests.count())
            rows = rows.select("region", "block", "visits", "sid", "grp", "text").sortWithinPartitions("region", "block", "visits", "sid")
            more = stored(on_arrow(rows, self.join_visitors, "u binary, v binary"), folder, "more")
            freed(spark)
            roots = components(trees.union(more))

        labels = base.select("id", "fp", "n", "sid").join(roots, base["sid"] == roots["u"], "left").select(
            "id", "fp", "n", F.coalesce("root", "sid").alias("class"))
        # written, so that the join below has a shuffle on both sides and Spark
        # can split a class that holds many of the rows
        leaders = labels.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("leader"))
        leaders = stored(in_files(leaders, size), folder, "leaders")
        return labels.join(leaders, "class", "left").select(
            F.struct(F.nullif("id", F.lit(LAST)).alias("id"), "fp").alias("k"), F.col("n").alias("n_shingles"),
            F.nullif(F.coalesce("leader", "id"), F.lit(LAST)).alias("component_id"))


def op4(spark, sf_dir):
    return Join().classes(table(spark, sf_dir, "documents")).select(F.col("k.id").alias("doc_id"), "n_shingles", "component_id")


def keep_first(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Pipeline form: of each class the rows with the smallest id stay (one
    row of those that are equal); rows without an id stay if no row of their
    class has one."""
    spark = df.sparkSession
    x, number = numbered(df, "doc_id", "text")
    folder = scratch(spark)
    seen = Join(words, percent).classes(x, number=number).groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.first(F.expr("component_id <=> k.id")).alias("good"))
    # rows of all other keys stay where they are
    special = stored(seen.where("NOT good OR copies > 1"), folder, "special")
    freed(spark)
    own = F.struct(F.col("doc_id").cast("long").alias("id"), F.col(number).alias("fp"))
    mine, flag = names(x, "mine", "flag")
    rows = flagged(x.withColumn(mine, own), F.col(mine), special, F.col("k"), folder, "special-bits", flag)
    theirs, copies, good = names(rows, "theirs", "copies", "good")
    special = special.select(F.col("k").alias(theirs), F.col("copies").alias(copies), F.col("good").alias(good))
    doubtful = rows.where(F.col(flag)).join(special, F.col(mine).eqNullSafe(F.col(theirs)), "left").where(F.coalesce(good, F.lit(True)))
    once = lambda d: d.select(*[F.col(f"`{c}`") for c in df.columns])
    out = once(rows.where(~F.col(flag))).union(once(doubtful.where(F.col(copies).isNull())))
    return out.union(once(doubtful.where(F.col(copies) > 1)).dropDuplicates(["doc_id", "text"]))


def sql_classes(src: str = "documents", words: int = WORDS, percent: int = PERCENT, p: str = "j") -> str:
    """CTEs ending in ``{p}_classes`` (doc_id, n_shingles, component_id):
    pairs by a shared n-gram, components by a recursive reach."""
    return f"""
{p}_w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {src}),
{p}_s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: md5(array_to_string(w[i:i + {words - 1}], ' ')))
    WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS g FROM {p}_w),
{p}_g AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM {p}_s),
{p}_l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM {p}_g a JOIN {p}_g b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
{p}_r AS (SELECT doc_id AS u, doc_id AS m FROM {p}_s UNION SELECT {p}_l.v, {p}_r.m FROM {p}_r JOIN {p}_l ON {p}_l.u = {p}_r.u AND {p}_r.m < {p}_l.v),
{p}_classes AS (SELECT doc_id, len(g) AS n_shingles, m AS component_id FROM {p}_s JOIN (SELECT u, min(m) AS m FROM {p}_r GROUP BY u) x ON x.u = doc_id)"""


SQL = f"WITH RECURSIVE {sql_classes()} SELECT * FROM j_classes"
