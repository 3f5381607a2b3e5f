"""Documents without an id of their own: null and repeated ids, and texts of
which the first 32 bits of a hash agree."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from acrewise.llm import debruijn_dedup, jaccard_join, suffix_dedup
from acrewise.llm.common import numbered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def colliding(spark):
    """Two texts of 40 words that agree in the low 32 bits of xxhash64."""
    words = " ".join(f"w{k}" for k in range(39))
    x = spark.range(300_000).select(F.concat(F.lit(words + " "), F.col("id").cast("string")).alias("t"))
    x = x.withColumn("h", F.xxhash64("t").bitwiseAND(0xFFFFFFFF))
    r = x.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a < b").first()
    return r.a, r.b


def rows_of(spark):
    rng = random.Random(3)
    a, b = colliding(spark)
    prose = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(6)]
    return ([(1, a), (None, a), (None, b.replace("w", "v")), (None, b), (2, prose[0]), (2, prose[1]), (2, prose[1]), (3, prose[0]), (None, prose[2]), (None, prose[2]),
             (5, prose[3] + " " + prose[4]), (5, prose[4]), (6, prose[5]), (7, None), (7, ""), (None, None)])


def distinct(rows):
    """The documents in order: distinct (id, text), null ids last."""
    return sorted({(i if i is not None else 2**63 - 1, t or "") for i, t in rows})


def test_numbers_tell_documents_apart(spark):
    rows = rows_of(spark)
    df, number = numbered(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    got = df.collect()
    assert len(got) == len(rows)
    assert len({(r.doc_id, r[number]) for r in got}) == len(distinct(rows))
    assert all(r[number] == 0 for r in got if r.doc_id in (1, 3, 6)) and all(r[number] for r in got if r.doc_id in (None, 2, 5, 7))
    alone, number = numbered(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"), "doc_id", "text")
    assert {r[number] for r in alone.collect()} == {0}


def test_byte_strings_of_documents_without_ids(spark):
    """Strings that another document of the same id holds count as well; the
    order within an id is free, so the least of them is only checked where one
    document alone holds a string before."""
    rows = rows_of(spark)
    docs = distinct(rows)
    where = Counter(s for _, t in docs for s in {t[k:k + 100] for k in range(len(t) - 99)})
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    kept = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in got)
    alone = [(i, t) for i, t in rows if t and all(where[t[k:k + 100]] == 1 for k in range(len(t) - 99))]
    assert any(i is None for i, _ in alone)
    for i, t in alone:
        assert kept[i, len(t), 0] >= 1
    first = {}
    for i, t in docs:
        for k in range(len(t) - 99):
            first.setdefault(t[k:k + 100], i)
    for i, t in {(1, rows[0][1]), (3, rows[7][1])}:
        gone = set()
        for k in range(len(t) - 99):
            if first[t[k:k + 100]] < i:
                gone.update(range(k, k + 100))
        assert kept[i, len(t), len(gone)] == 1


def test_word_windows_of_documents_without_ids(spark):
    rows = rows_of(spark)
    docs = [(i, WORD.findall(t)) for i, t in distinct(rows)]
    where = Counter(tuple(w[k:k + 35]) for _, w in docs for k in range(len(w) - 34))
    want = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 34):
            if where[tuple(w[k:k + 35])] > 1:
                gone.update(range(k, k + 35))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()] += 1
    got = debruijn_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert (None, 40, 0, hashlib.sha256(rows[2][1].encode()).hexdigest()) in want


def test_classes_and_kept_rows_of_documents_without_ids(spark):
    rows = rows_of(spark)

    def grams(t, n):
        w = WORD.findall((t or "").lower())
        return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}

    def near(x, y, n, percent):
        return bool(x) and 100 * len(x & y) >= percent * len(x | y)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, _number string")
    for n, percent in ((4, 85), (5, 80)):
        sets = [grams(t, n) for _, t in rows]
        root = list(range(len(rows)))
        for _ in rows:
            root = [min([root[k] for k, y in enumerate(sets) if near(x, y, n, percent)], default=root[j]) for j, x in enumerate(sets)]
        least = [min((rows[k][0] for k in range(len(rows)) if root[k] == root[j] and rows[k][0] is not None), default=None) if sets[j] else rows[j][0] for j in range(len(rows))]
        if n == 4:
            got = jaccard_join.Join().classes(df).collect()
            assert Counter((r.k.id, r.n_shingles, r.component_id) for r in got) == Counter((i, len(s), c) for (i, _), s, c in zip(rows, sets, least))
        else:
            got = jaccard_join.keep_first(df)
            assert got.columns == df.columns
            assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, {(i, t) for (i, t), c in zip(rows, least) if i == c}))
