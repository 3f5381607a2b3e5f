"""Op 4: texts that share a line, and little else, do not end up in one region."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from acrewise.llm import jaccard_join


def _words(rng, n):
    return [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]


def _classes(docs, words=4, percent=85):
    sets = {i: {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} for i, w in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def _texts(rng):
    """300 texts of every size with one line, near copies of some, and a group
    of near copies that is larger than a list."""
    line = _words(rng, 24)
    texts = [line + _words(rng, rng.randint(10, 30)) for _ in range(300)]
    texts += [t[:-1] + _words(rng, 1) for t in texts[::5]]
    group = _words(rng, 80)
    for _ in range(90):
        k = rng.randrange(80)
        texts.append(group[:k] + _words(rng, 1) + group[k + 1:])
    return list(enumerate(texts))


@pytest.fixture
def largest(monkeypatch):
    """The points of the largest region of each join, where no minimum hashes help."""
    seen, was = [], jaccard_join.stored

    def stored(df, folder, name):
        out = was(df, folder, name)
        if name == "placed":
            seen.append(out.groupBy("region").count().agg(F.max("count")).first()[0])
        return out
    monkeypatch.setattr(jaccard_join, "stored", stored)
    monkeypatch.setattr(jaccard_join, "AGREE", jaccard_join.BINS + 1)
    return seen


def test_texts_with_a_common_line_stay_in_regions_of_their_own(spark, largest):
    docs = _texts(random.Random(7))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {r.k.id: r.component_id for r in jaccard_join.Join().classes(df).collect()}
    assert got == _classes(docs)
    assert len(largest) == 1 and largest[0] <= 120  # the group of 90, not the texts with the line


def test_near_duplicates_of_the_pipeline_with_a_common_line(spark, largest):
    docs = _texts(random.Random(8))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == sorted(set(_classes(docs, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT).values()))
    assert len(largest) == 1 and largest[0] <= 120


def test_holders_count_shared_ngrams():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(50)]
    held = jaccard_join.Holders(sets)
    for g in [*sets, np.array([100], np.uint64)]:
        assert held.shared(g).tolist() == [len(np.intersect1d(g, x)) for x in sets]
