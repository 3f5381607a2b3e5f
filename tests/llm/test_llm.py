"""The training-data operators against brute force, the public tokenizer
library, exact round trips and their DuckDB SQL, on edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from acrewise.llm import (decontaminate, jaccard_join, line_dedup, mixture, quality, queries, repeats, shards,
                          symbols, token_counts, warc)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
RNG = random.Random(7)
VOCAB = ["the", "of", "and", "to", "in", "is", "Der", "die", "été", "naïve", "x", "ab", "Zürich", "日本", "don't", "a|b"] + [f"w{i}" for i in range(60)]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def edge_texts():
    """Nulls, blanks, ties, copies, near copies, shared passages, long runs."""
    passage, body = prose(60), prose(150)
    words = body.split(" ")
    near = [" ".join(words[:k] + ["changed"] + words[k + 1:]) for k in (3, 40, 149)]
    far = " ".join(w if i % 9 else "zz" for i, w in enumerate(words))
    texts = [None, "", "   \n\t ", "one", "one", "two words", body, body, body.upper(), *near, far,
             f"{prose(30)}\n{passage}\n{prose(30)}", f"{passage} {prose(80)}", f"{prose(80)} {passage}", passage,
             "ab" * 300, "ab" * 300 + " tail", "\n".join(["All rights reserved.", " all rights RESERVED. ", prose(20), "", "short"]),
             "\n".join([prose(20), "All rights reserved.", "All rights reserved."]), " ".join(["rep eat ed"] * 40), prose(3000),
             "it's they'RE ''s ΟΔΟΣ ½ <|endoftext|> 日本語　é İ 😀😀 a1234 " + "q" * 900]
    return texts + [prose(RNG.randint(1, 120)) for _ in range(20)]


@pytest.fixture(scope="module")
def edge(tmp_path_factory):
    """A folder with the tables, and the documents as a list of rows."""
    at = tmp_path_factory.mktemp("edge")
    langs, sources = ["en", "fr", None, "xx"], ["hot", "hot", "b", None]
    rows = [(i, t, langs[i % 4], sources[i % 4], len(t or "")) for i, t in enumerate(edge_texts())]
    pq.write_table(pa.Table.from_pylist([dict(zip(DOCS.names, r)) for r in rows], DOCS), at / "documents.parquet")
    items = [{"item_id": i, "text": t} for i, t in enumerate([" ".join(WORD.findall(rows[6][1])[20:60]), None, "", "too short", prose(40), " ".join(prose(9).split()[:9])])]
    pq.write_table(pa.Table.from_pylist(items, pa.schema([("item_id", pa.int64()), ("text", pa.string())])), at / "benchmark.parquet")
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 30_000, "é" * 30_000, "x" * 4096, "\r\n\r\nWARC/1.0\r\n0\r\n\r\n", "<p>a</p>"]
    pages = [{"page_id": i if i < 8 else None, "url": None if i == 3 else f"http://h/{i}?a=\n%", "html": h} for i, h in enumerate(html)]
    pq.write_table(pa.Table.from_pylist(pages, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])), at / "pages.parquet")
    return str(at), rows


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def same_as_sql(df, sql, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(sql)
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
def test_query_equals_sql_on_edge_cases(spark, edge, name):
    same_as_sql(queries.QUERIES[name](spark, edge[0]), queries.SQL[name], edge[0])


def test_pipeline_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    same_as_sql(corpus_pipeline.run(spark, folder), corpus_pipeline.ORACLE_SQL, folder)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t, schema in (("documents", DOCS), ("benchmark", pa.schema([("item_id", pa.int64()), ("text", pa.string())])),
                      ("pages", pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]))):
        pq.write_table(schema.empty_table(), tmp_path / f"{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def odd_rows(spark, rows):
    """Repeated rows, null ids and columns named like the operators' own."""
    some = [(*r, 1, 2, "x", True) for r in rows[:14]]
    some += some[3:8] + [(None, "lost words here", None, None, None, 1, 2, "x", True)] * 2
    return spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long, shard int, k int, topic string, selected boolean")


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns_with_odd_rows(spark, edge, stage):
    df = odd_rows(spark, edge[1])
    out = corpus_pipeline.STAGES[stage][1](spark, df, edge[0])
    got = out.collect()
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == df.columns
        assert not Counter(got) - Counter(df.collect())
    else:
        assert sorted(out.columns) == sorted([*df.columns, "slot"]) and len(got) == df.count()
    if stage == 1:
        assert len({(r.doc_id, r.text) for r in got}) == len(got)


# ---- 1 ------------------------------------------------------------------


def test_masks_find_every_window_with_the_allowed_substitutions():
    n = decontaminate.WINDOW
    for bad in itertools.combinations(range(n), decontaminate.SUBSTITUTIONS):
        assert any(all(m[i] == "0" or s + i not in bad for i in range(len(m)))
                   for m in decontaminate.MASKS for s in range(n - len(m) + 1))
    assert min(map(len, decontaminate.MASKS)) == decontaminate.MIN_ITEM


def test_substituted_passages_and_shuffle_join(spark):
    item = [f"t{i}" for i in range(30)]
    docs = [(n, " ".join(["a"] * 5 + [("zz" if i in bad else w) for i, w in enumerate(item)])) for n, bad in enumerate(
        [(), (7, 15), (7, 15, 22), set(range(0, 30, 5)), set(range(0, 30, 4)), (0, 1, 14, 28, 29)])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(9, "T%s." % "; t".join(map(str, range(30))))], "item_id long, text string")

    def best(bad):
        return max(sum(i not in bad for i in range(s, s + 15)) for s in range(16))
    want = {n: best({i for i, w in enumerate(t.split()[5:]) if w == "zz"}) for n, t in docs}
    want = {n: b for n, b in want.items() if b >= 13}
    for limit in (decontaminate.MAX_BROADCAST, 0):
        got = decontaminate.leaks(df, bench, max_broadcast=limit).collect()
        assert {r.k.id: r.best_match for r in got} == want and len(got) == len(want)


# ---- 2 ------------------------------------------------------------------


def test_shards_match_the_mixture(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    rows = shards.interleave(df).collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    total = Counter(r.source for r in rows)
    for s in range(8):
        mine = Counter(r.source for r in rows if r.shard == s)
        assert all(abs(mine[k] - n / 8) <= 1.5 for k, n in total.items())


# ---- 3 ------------------------------------------------------------------


def test_archive_round_trip_keeps_payloads(spark, edge, tmp_path):
    pages = spark.read.parquet(f"{edge[0]}/pages.parquet")
    pages = pages.union(pages.where("page_id IN (0, 4)"))  # repeated rows
    warc.write_archive(pages, f"{tmp_path}/warc", f"{tmp_path}/scratch")
    got = warc.read_archive(spark, f"{tmp_path}/warc").collect()
    assert len(got) == 11 and len({r.id for r in got}) == 11
    stored = {r.id: bytes(r.payload) for r in got if r.kind == "response"}
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert len(stored) == len(set(html.values()))
    for r in got:
        assert stored[r.refers_to if r.kind == "revisit" else r.id] == html[r.page_id]


@pytest.mark.parametrize("damage", [lambda rs: rs[:1], lambda rs: rs[::2], lambda rs: [rs[0], rs[1].replace(b"abc", b"abd", 1), *rs[2:]],
                                    lambda rs: [r.replace(b"Total-Length: ", b"Total-Length: 1") for r in rs]])
def test_damaged_archives_raise(damage):
    page = {"page_id": [1], "url": ["u"], "html": [b"abc" * 20_000], "copy": [0], "first_id": [None], "first_url": [None], "found": [False]}
    out = next(warc.compose(iter([pa.RecordBatch.from_pydict(page)]))).column(0).to_pylist()
    assert len(out) > 2
    import gzip
    data = gzip.compress(b"".join(r + b"\r\n\r\n" for r in damage(out)))
    with pytest.raises(ValueError):
        recs = [r for b in warc.cut(iter([pa.RecordBatch.from_pydict({"content": [data]})])) for r in b.to_pylist()]
        recs.sort(key=lambda r: r["segment"])
        head = next(r for r in recs if r["kind"] == "response")
        whole = {"kind": ["response"], "id": [head["id"]], "page_id": [1], "refers_to": [None], "digest": [head["digest"]],
                 "total": [max((r["total"] or 0) for r in recs)], "numbers": [[r["segment"] for r in recs]], "blocks": [[r["block"] for r in recs]]}
        list(warc.decode(iter([pa.RecordBatch.from_pydict(whole)])))


# ---- 4 ------------------------------------------------------------------


def test_classes_in_small_blocks_and_all_hot(spark, monkeypatch):
    """Near copies at every distance; tiny regions and an order in which all
    n-grams are frequent give the same classes."""
    base = [f"b{i}" for i in range(80)]
    rng = random.Random(3)
    docs = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(80), rng.randint(0, 9)):
            w[k] = f"e{rng.randint(0, 40)}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join(base[:20] + [f"u{i}_{k}" for k in range(60)])) for i in range(40)]

    def grams(t):
        w = t.split()
        return {tuple(w[i:i + 4]) for i in range(len(w) - 3)}
    sets = {i: grams(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {i: find(i) for i in sets}
    assert 5 < len(set(want.values())) < 150
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for size, hot in ((jaccard_join.REGION_BYTES, jaccard_join.HOT_LIST), (20_000, 1)):
        monkeypatch.setattr(jaccard_join, "REGION_BYTES", size)
        monkeypatch.setattr(jaccard_join, "HOT_LIST", hot)
        got = {r.k.id: r.component_id for r in jaccard_join.Join().classes(df).collect()}
        assert got == want


def _truncated(rng, n):
    """(A, B): A of n words, B the part of A that is still a link, or just not."""
    a = [f"t{rng.randrange(10 ** 9)}" for _ in range(n)]
    return a, a[:-(-85 * (n - 3) // 100) + 3 + rng.choice([-1, 0, 0, 1, 2])]


def test_truncated_copies_of_a_frequent_text_are_candidates():
    """All n-grams of A's window frequent, those of B beyond it rare; no
    regions that could help, no Spark needed."""
    join, rng = jaccard_join.Join(), random.Random(5)
    hot, rows, links = np.zeros(jaccard_join.HOT_BITS, bool), [], []
    for k in range(300):
        pair = [next(join.sets(pa.array([" ".join(x)]))) for x in _truncated(rng, rng.randint(30, 160))]
        lows = [g[:-(-3 * join.prefix(len(g)) // 2)].view(np.int64) for g in pair]
        hot[lows[0] & (jaccard_join.HOT_BITS - 1)] = True
        rows += [{"d": 2 * k + i, "region": 2 * k + i, "n": len(g), "low": low} for i, (g, low) in enumerate(zip(pair, lows))]
        if 100 * len(pair[1]) >= 85 * len(pair[0]):  # B's n-grams are all A's
            links.append((2 * k, 2 * k + 1))
    schema = pa.schema([("d", pa.int64()), ("region", pa.int64()), ("n", pa.int64()), ("low", pa.list_(pa.int64()))])
    entries = pa.Table.from_batches(join.entries(hot)(iter([pa.RecordBatch.from_pylist(rows, schema)])))
    entries = entries.sort_by([("s", "ascending"), ("region", "ascending"), ("d", "ascending")]).combine_chunks()
    met = {tuple(sorted((v["d"], v["region"]))) for b in join.meet(iter(entries.to_batches())) for v in b.to_pylist()}
    assert len(links) > 150
    assert [x for x in links if x not in met] == []


def test_copies_truncated_copies_and_quotes(spark):
    """40 copies of each A, truncated copies at the limit, and pages that
    quote half of those and draw them into other regions."""
    rng, docs, links = random.Random(11), [], []
    for k in range(30):
        a, b = _truncated(rng, 119)
        at = len(docs)
        quotes = [[f"q{rng.randrange(10 ** 9)}" for _ in range(70)] + b[j:j + len(b) // 2] for j in (0, len(b) // 4, len(b) // 2)]
        docs += [" ".join(x) for x in [*quotes, b, *[a] * 40]]
        links += [(at + 4, at + 4 + i) for i in range(40)]
        if 100 * (len(b) - 3) >= 85 * (len(a) - 3):
            links.append((at + 3, at + 4))
    want = list(range(len(docs)))
    for x, y in links:
        want[y] = x
    want = [want[x] for x in want]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.k.id: r.component_id for r in jaccard_join.Join().classes(df).collect()}
    assert got == dict(enumerate(want))


# ---- 5 ------------------------------------------------------------------


def test_copied_and_long_junk_does_not_move_the_references(spark):
    """One rejected text as a third of its language's rows, and one of
    millions of characters, leave the other verdicts as they are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang").cache()
    judged = quality.judge(docs).collect()
    before = {r.k.id: r.kept for r in judged}
    far = sorted((r.char_distance, r.k.id) for r in judged if not r.base_failed and r.char_distance and r.char_distance > quality.MAX_CHAR_DISTANCE)
    junk = docs.where(F.col("doc_id") == far[-1][1])
    copies = junk.crossJoin(spark.range(len(before) // 2)).select((F.col("id") + 10 ** 6).alias("doc_id"), "text", "lang")
    long = junk.select(F.lit(10 ** 7).cast("long").alias("doc_id"), F.repeat("text", 2000).alias("text"), "lang")
    after = {r.k.id: r.kept for r in quality.judge(docs.union(copies)).collect()}
    assert {k: v for k, v in after.items() if k < 10 ** 6} == before
    assert not any(v for k, v in after.items() if k >= 10 ** 6)
    after = {r.k.id: r.kept for r in quality.judge(docs.union(long)).collect()}
    assert sum(after[k] != v for k, v in before.items()) <= 0.01 * len(before) and not after[10 ** 7]


def test_quality_rejects_junk_and_keeps_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    j = quality.judge(docs).where("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in j.join(labels, F.col("k.id") == F.col("doc_id")).groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n[0, False] >= 2 * n.get((0, True), 0)


# ---- 6 ------------------------------------------------------------------


def test_token_counts_equal_the_library(edge):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [t or "" for _, t, *_ in edge[1]] + ["'", "'s", "a's'll 'tis", "<|startoftext|><|endoftext|>", "x\x1cy\x85z", "Σ ΑΣ"]
    texts += [r[0] for r in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    t = token_counts.Transducer(path)
    assert t.count(texts).tolist() == want


def test_token_counts_do_not_depend_on_chunks(edge, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [t or "" for _, t, *_ in edge[1]]
    whole = token_counts.Transducer(path).count(texts).tolist()
    monkeypatch.setattr(token_counts, "CHUNK", 50)
    monkeypatch.setattr(token_counts, "CACHED_PIECES", 10)
    assert token_counts.Transducer(path).count(texts).tolist() == whole


def test_op6_query(spark, edge):
    pytest.importorskip("public_tokenizers")
    got = by_id(queries.QUERIES["op6_transducer_counts"](spark, edge[0]), "n_bytes", "n_tokens", "over_limit")
    assert len(got) == len(edge[1]) and got[0] == (0, 0, False)
    assert all(v[0] == len((edge[1][i][1] or "").encode()) and v[2] == (v[1] > 2048) for i, v in got.items())


# ---- 7 and 9 ------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_repeats_in_small_parts_equal_brute_force(seed, monkeypatch):
    """Anchors, classes and windows on strings over two letters, cut into
    tiny parts and batches; no Spark needed."""
    monkeypatch.setattr(symbols, "SEGMENT", 40)
    rng = random.Random(seed)
    docs = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 160))) for _ in range(12)]
    docs += [docs[3] + "b" * 60, "a" * 90, docs[5], docs[5][10:70] + docs[7][:50]]
    for every in (False, True):
        r = repeats.Repeats(12, 5, symbols.byte_values, every)
        monkeypatch.setattr(symbols, "pieces", lambda o, m, size=40, f=_pieces: f(o, m, size))
        n = len(docs)
        rows = [(np.full(1, i), np.full(1, 0), pa.array([docs[i]])) for i in range(n)]
        parts = [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), c], ["id", "fp", "text"]) for a, b, c in rows]
        found = pa.Table.from_batches([b for k in range(0, n, 5) for b in r.find_anchors(iter(parts[k:k + 5]))]).to_pandas()
        ranges = defaultdict(list)
        out = stream(repeats.classes(every), found, ["settled", "a", "c", "h", "id", "fp", "pos"])
        out["left"], out["right"] = out.h // 65536, out.h % 65536
        for x in out[~out.split].itertuples():
            ranges[x.id] += [x.pos - r.length + r.k, x.pos + r.length]
        split, want_at = out[out.split], defaultdict(list)
        for bit, side in ((1, "left"), (2, "right")):
            for x in split[split.duplicated(["a", side], keep=False)].itertuples():
                want_at[x.id].append(4 * x.pos + bit)
        spelled = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([0]), pa.array([docs[i]]), pa.array([at])], ["id", "fp", "text", "at"]) for i, at in want_at.items()]
        single = [b for k in range(0, len(spelled), 3) for b in r.find_windows(iter(spelled[k:k + 3]))]
        if single:
            for x in stream(repeats.equal_windows(every), pa.Table.from_batches(single).to_pandas(), ["settled", "a", "id", "fp", "pos"]).itertuples():
                ranges[x.id] += [x.pos, x.pos + r.length]
        seen, where = Counter(), {}
        for i, d in enumerate(docs):
            for s in range(len(d) - 11):
                seen[d[s:s + 12]] += 1
                where.setdefault(d[s:s + 12], (i, s))
        for i, d in enumerate(docs):
            want = np.zeros(len(d), bool)
            for s in range(len(d) - 11):
                if seen[d[s:s + 12]] > 1 and (every or where[d[s:s + 12]] != (i, s)):
                    want[s:s + 12] = True
            assert repeats.marked(len(d), ranges[i]).tolist() == want.tolist()


_pieces = symbols.pieces


def stream(fn, rows, order):
    """Sorted rows through fn in batches of three."""
    rows = rows.sort_values(order)
    cols = [c for c in order[1:]] + ["settled"]
    batches = [pa.RecordBatch.from_pandas(rows[cols].iloc[k:k + 3], preserve_index=False) for k in range(0, len(rows), 3)]
    return pa.Table.from_batches(list(fn(iter(batches)))).to_pandas()


def test_word_values_tell_words_apart():
    texts = ["a b", "ab", "", " a\tb ", "b", "A b", "日本 日"]
    v, at = symbols.word_values(*symbols.text_bytes(pa.array(texts)))
    assert [int(x) for x in np.diff(at)] == [len(WORD.findall(t)) for t in texts]
    words = [w for t in texts for w in WORD.findall(t)]
    assert len(set(v.tolist())) == len(set(words)) == len({(w, x) for w, x in zip(words, v.tolist())})
    folded, _ = symbols.word_values(*symbols.text_bytes(pa.array(["A b", "a b"])), fold=True)
    assert folded[0] == folded[2]


# ---- 8 ------------------------------------------------------------------


def test_raking_meets_its_targets(spark):
    rng = random.Random(1)
    cells = [(s, l, t, rng.randint(1, 1000) * (50 if s == "vhot" else 1)) for s in ("vhot", "va", "vb", "-") for l in ("ven", "vfr", "vde", "ves", "-") for t in ("prose", "table")]
    df = spark.createDataFrame(cells, "s string, l string, t string, n long")
    x = mixture.rake(df).collect()
    total = sum(r.w for r in x)
    for by in ("s", "t"):
        flat = defaultdict(float)
        for r in cells:
            flat["slt".index(by) and r[2] or r[0]] += r[3]
        flat = {k: v ** mixture.FLATTEN for k, v in flat.items()}
        for k, v in flat.items():
            assert sum(r.w for r in x if r[by] == k) / total == pytest.approx(v / sum(flat.values()), rel=1e-3)
    for k, v in mixture.LANGUAGES.items():
        assert sum(r.w for r in x if r.l == "v" + k) / total == pytest.approx(v, rel=1e-3)


def test_raking_goes_on_until_the_targets_hold(spark):
    """Sources that are almost of one language each need more rounds."""
    langs = ("ven", "vfr", "vde", "ves")
    cells = [(f"v{i}", l, t, 100_000 * (1 + j) if i == k else 100) for i in range(4) for k, l in enumerate(langs) for j, t in enumerate(("prose", "table"))]
    df = spark.createDataFrame(cells, "s string, l string, t string, n long")
    x = mixture.rake(df).collect()
    flat = defaultdict(float)
    for s, _, _, n in cells:
        flat[s] += n
    flat = {k: v ** mixture.FLATTEN for k, v in flat.items()}
    for k, v in flat.items():
        assert sum(r.w for r in x if r.s == k) == pytest.approx(v / sum(flat.values()), abs=1e-8)
    for k, v in mixture.LANGUAGES.items():
        assert sum(r.w for r in x if r.l == "v" + k) == pytest.approx(v, abs=1e-8)


def test_targets_that_cannot_be_met_are_reported(spark):
    df = spark.createDataFrame([("va", "ven", "prose", 900), ("vb", "vfr", "prose", 100)], "s string, l string, t string, n long")
    with pytest.warns(RuntimeWarning, match="cannot be met"):
        assert mixture.rake(df, {"en": 0.5, "fr": 0.5}).count() == 2


def test_sample_follows_probabilities(spark):
    rows = mixture.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert max(r.probability for r in rows) == 1.0
    want = sum(r.probability for r in rows)
    assert abs(sum(r.selected for r in rows) - want) < 4 * want ** 0.5


# ---- 10 -----------------------------------------------------------------


def test_line_bitmaps_with_and_without_hot_lines(spark, edge, monkeypatch):
    import zlib
    df = spark.read.parquet(f"{edge[0]}/documents.parquet")
    got = []
    for hot in (line_dedup.HOT_LINES, 1):
        monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
        rows = line_dedup.dedup(df).collect()
        got.append(sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows))
    assert got[0] == got[1]
    for r in rows:
        text = edge[1][r.doc_id][1] or ""
        keep = np.unpackbits(np.frombuffer(zlib.decompress(r.keep_bitmap), np.uint8))[:r.n_lines]
        assert hashlib.sha256("\n".join(x for x, k in zip(text.split("\n"), keep) if k).encode()).hexdigest() == r.kept_sha256
        assert r.n_dropped == r.n_lines - keep.sum()
