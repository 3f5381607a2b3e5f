"""Operators 11 to 13 against brute force: SetSketch near duplicates, the
audit of sources, spelling variants. (Their SQL on the edge documents and empty
tables are in test_llm.py.)"""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest

from acrewise.llm import divergence, setsketch, spelling

ODD = "doc_id long, text string, lang string, source string, n long, word string, d long, cluster string, code int"


def odd(spark, rows):
    """Rows with columns named like the operators' own."""
    return spark.createDataFrame([(*r, 1, "w", 2, "c", 3) for r in rows], ODD)


# ---- 11 -----------------------------------------------------------------


def near_texts(seed):
    """Near copies of one text at every distance, some of them repeated."""
    rng, base, docs = random.Random(seed), [f"b{i}" for i in range(80)], []
    for _ in range(150):
        w = list(base)
        for k in rng.sample(range(80), rng.randint(0, 7)):
            w[k] = f"e{rng.randint(0, 40)}"
        docs.append(" ".join(w))
    docs += [" ".join(base[:20] + [f"u{i}_{k}" for k in range(60)]) for i in range(30)]
    return docs + docs[:10] + [None, "", " \t ", "one", "One", "two words", "words two", docs[3].upper(), " ".join(base * 400)]


def classes_by_force(rows, words=3, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] += [key] if key is not None else []
    out = []
    for i, (key, _) in enumerate(rows):
        c = min(least[find(i)], default=None) if sets[i] else key
        out.append((key, len(sets[i]), c))
    return Counter(out)


def test_registers_merge_and_meet_at_the_rate_of_the_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    one, other = np.sort(a[:2000]), np.sort(a[1000:])
    x, y, both = setsketch.registers([one, other, np.unique(a)])
    assert (both == np.maximum(x, y)).all()
    assert abs((x == y).mean() - 1 / 3) < 0.15
    alone = setsketch.registers([np.sort(a[:1])])
    assert alone.shape == (1, setsketch.M) and (alone > 0).all()


@pytest.mark.parametrize("share,n2", [(0.5, 1000), (0.6, 1000), (0.75, 1000), (0.85, 1000), (0.9, 950)])
def test_likelihood_tells_close_pairs_from_others(share, n2):
    rng, hits = np.random.default_rng(7), 0
    for _ in range(60):
        both = round(share * (1000 + n2) / (1 + share))
        a = rng.integers(0, 2**63, 1000 + n2 - both).astype(np.uint64)
        x, y = setsketch.registers([np.sort(a[:1000]), np.sort(a[1000 - both:])])
        hits += bool(setsketch.rises(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([1000]), np.array([n2]))[0])
    assert hits == 60 if share >= 0.85 else hits <= 12 if share <= 0.6 else True


@pytest.mark.parametrize("small", [False, True])
def test_classes_equal_brute_force(spark, monkeypatch, small):
    """Null, repeated and colliding ids; tiny blocks of buckets and clusters."""
    if small:
        monkeypatch.setattr(setsketch, "BLOCK_BYTES", 20_000)
        monkeypatch.setattr(setsketch, "BUCKET_BLOCK", 8)
    texts = near_texts(5)
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[40]), (3, texts[41]), (3, texts[41]), (None, "one")]
    df = odd(spark, [(i, t, "en", "s") for i, t in rows])
    got = Counter((r.id, r.n_shingles, r.component_id) for r in setsketch.classes(df).collect())
    want = classes_by_force(rows)
    assert 5 < len({c for _, _, c in want}) < 150
    assert got == want


# ---- 12 -----------------------------------------------------------------


def audit_by_force(rows):
    low = {c: c + 32 for c in range(65, 91)}
    count, docs, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        count[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    share = lambda n, total: 1 + 10**9 * (n + 1) // total
    for lang in {g[0] for g in groups}:
        terms = [t for (x, t), n in docs.items() if x == lang and n >= 3]
        mine = sorted(s for x, s in groups if x == lang)
        n = {s: sum(count[lang, s][t] for t in terms) for s in mine}
        p = {s: {t: share(count[lang, s][t], n[s] + len(terms)) for t in terms} for s in mine}
        q = {t: share(sum(count[lang, s][t] for s in mine), sum(n.values()) + len(terms)) for t in terms}
        f = lambda a, b: (a - b) ** 2 // b
        for s in mine:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in terms)) for o in mine if o != s]
            some = [("term", t, f(p[s][t], q[t])) for t in terms if count[lang, s][t] and p[s][t] > q[t]]
            for part in (pairs, some):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, k + 1) for k, x in enumerate(part) if x[0] == "pair" or k < divergence.RANKS]
    return sorted(out)


def test_pointers_are_sorted_as_terms():
    rng = random.Random(2)
    terms = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(500)] + ["aaaaaaaa", "aaaaaaaaa", "é" * 8, "日本語" * 9] * 3
    data = np.frombuffer(" 1".join(terms).encode(), np.uint8)
    start, size = divergence.pointers(data)
    assert divergence.spelled(data, start, size).to_pylist() == terms
    order, new = divergence.pointer_sort(data, start, size)
    got = [terms[k] for k in order]
    assert got == sorted(terms, key=str.encode)
    assert new.tolist() == [True] + [a != b for a, b in zip(got, got[1:])]
    assert all(a < b for a, b, n in zip(order, order[1:], new[1:]) if not n)


def test_shares_are_exact_beyond_64_bits():
    n, total = np.array([0, 5, 9 * 10**12, 88_999_999_999_999]), np.array([1, 7, 10**13, 9 * 10**13])
    assert divergence.parts(n, total).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, total)]


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small):
    """Null columns, sources without terms, languages without kept terms, long
    texts cut into slices, blocks of a few terms."""
    if small:
        monkeypatch.setattr(divergence, "SLICE", 300)
        monkeypatch.setattr(divergence, "BLOCK", 7)
        monkeypatch.setattr(divergence, "RANKS", 4)
    rng = random.Random(9)
    vocab = ["the", "The", "Zürich", "été", "日本", "x", "averylongwordindeed", "averylongwordindead"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(" ".join(rng.choices(vocab, k=rng.choice([3, 30, 200]))) + rng.choice(["", "-1", "\n"]), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "c", None])) for _ in range(60)]
    rows += [(None, "en", "void"), ("", None, "void"), ("single text", "xx", "a"), ("12 34", "xx", "b")] + rows[:5]
    df = odd(spark, [(None if i % 2 else 1, *r) for i, r in enumerate(rows)])
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit_by_force(rows)


# ---- 13 -----------------------------------------------------------------


def variants_by_force(rows):
    low, n = {c: c + 32 for c in range(65, 91)}, Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = defaultdict(set)
    less = defaultdict(list)
    for w in n:
        for i in range(len(w)):
            d = w[:i] + w[i + 1:]
            less[i, d].append(w)
            if d in n:
                near[w].add(d)
                near[d].add(w)
    for ws in less.values():
        for a, b in itertools.combinations(set(ws), 2):
            if len(a) == len(b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * c else None

    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), c, len(near[w]), n.get(form[w])) for w, c in n.items())


def spelling_rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÀ") for _ in range(rng.randint(6, 9))) for _ in range(400)]
    words += ["a" * k for k in range(7, 15)] + ["x" * 3000 + "y" * 3000, "x" * 3000 + "z" + "y" * 3000, "x" * 2999 + "y" * 3000, "x" * 6000]
    rows = []
    for i in range(60):
        some = [w.upper() if rng.random() < 0.1 else w for w in rng.choices(words[:40], k=120) + rng.choices(words, k=60)]
        rows.append((i if i % 5 else None, " ".join(some) + ".x×÷"))
    chain = ["chaining"] * 2 + ["chaininga"] * 20 + ["chainingab"] * 200 + ["chainingabc"] * 2000
    return rows + [(100, None), (101, ""), (102, " ".join(words * 3)), (103, " ".join(chain))] + rows[:3]


def same_variants(a, b):
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(a, key=key) == sorted(b, key=key)


def test_variants_equal_brute_force(spark):
    """Words over three letters, so that nearly all edits are words; nested
    words, long words, null and repeated ids, a chain of forms."""
    rows = spelling_rows(4)
    want = variants_by_force(rows)
    assert any(r[1] and r[1] != r[2] for r in want) and sum(r[4] for r in want) > 300
    got = spelling.variants(odd(spark, [(i, t, "en", "s") for i, t in rows]))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    same_variants([tuple(r) for r in got.collect()], want)


def test_a_words_letters_are_folded_before_the_checksum():
    batch = pa.RecordBatch.from_arrays([pa.array(["7", "8"]), pa.array(["ÀBCDEFGH Zürichberg abc", "Zürichberg"])], ["id", "text"])
    got = reduce(lambda x, y: x + y, (Counter(dict(zip(*b.to_pydict().values()))) for b in spelling.count(iter([batch]))))
    want = Counter()
    for key, w in (("7", "Àbcdefgh"), ("7", "zürichberg"), ("8", "zürichberg")):
        h = zlib.crc32(f"{key}:{w}".encode())
        w = w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w
        want[w] += 1
    assert got == want
