"""Op 13, spelling variants: words one edit apart, found by a trie frontier.

States (word, position, node, edits) walk a trie of all words, which is a
table of nodes with their edges. Each level joins the states with the nodes
they are at: a state without an edit goes on along its own word and branches
into its edits, a state with one edit goes on where the trie spells the rest of
its word, and one that ends where a word ends is a neighbour.

* Nodes without a branch are skipped: a node is as deep as the common prefix
  of its words, and a subtree of one word is compared as a whole. A level is a
  branch, not a letter.
* Edits are only made in the second half of a word, where the trie is thin;
  edits in the first half are found in the trie of the reversed words. Words
  enter at depth ``ENTRY``, so no node holds all words.
* Edits are undirected pairs: a replaced letter goes to a larger one, a deleted
  one to the shorter word, the last of a run of equal letters.

The nodes of a level are grouped from the states that have no edit; a node has
one edge a letter, at most as many as ``RUN`` allows. Levels are written to the
shared folder. A node that holds many states is a skewed join, which Spark
splits; the counts by node and letter are combined map-side.

A word's form is its near word of largest count, and its root the end of the
chain of forms: each form is ten times as frequent as the word before, so
chains are short; they are followed by pointer doubling.

Defined cases: null and empty texts have no words; a null id is spelled as '';
repeated rows count each time; very long texts are read word by word; a word of
any length is a word; ties go to the smallest form; an empty table gives an
empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import os.path
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrewise.llm import symbols
from acrewise.llm.common import dropped, on_arrow, scratch, stored, table

RUN = "[A-Za-zÀ-ÿ]+"
EVERY = 31        # runs whose checksum it divides lose a letter
MIN_LETTERS = 7
MIN_COUNT = 2
TIMES = 10        # how much more frequent a form is
ENTRY = 3         # depth of the first nodes: half of MIN_LETTERS
LONG = 1 << 20    # letters of a text from which its words are not listed at once

_WORD = re.compile(f"[a-zÀ-ÿ]{{{MIN_LETTERS},}}")  # shorter runs can give no word


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id as text, text) -> (word, n), one row for each word of a batch."""
    fold = bytes(symbols.FOLD)
    for b in batches:
        total: Counter = Counter()
        ids = b.column(0).to_pylist()
        data, ends = symbols.text_bytes(b.column(1))
        for k, key in enumerate(ids):
            text = data[ends[k]:ends[k + 1]].tobytes().translate(fold).decode()
            found = _WORD.findall(text) if len(text) < LONG else (m.group() for m in _WORD.finditer(text))
            base = zlib.crc32(f"{key}:".encode())
            for word, n in Counter(found).items():
                h = zlib.crc32(word.encode(), base)
                if h % EVERY == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
                    if len(word) < MIN_LETTERS:
                        continue
                total[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words that count."""
    docs = df.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return on_arrow(docs, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# ---- the trie --------------------------------------------------------------

def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges with the depth of the node that each leads to: the letters that
    its first and last word share."""
    for b in batches:
        lo, hi = (b.schema.get_field_index(c) for c in ("lo", "hi"))
        deep = [len(os.path.commonprefix(x)) for x in zip(b.column(lo).to_pylist(), b.column(hi).to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(deep, pa.int32())], [*b.schema.names, "deep"])


def edges(frontier: DataFrame) -> DataFrame:
    """Of the words at each node of depth d, one row for each next letter c
    ('' for the word that ends there)."""
    kids = (frontier.where("e = 0").groupBy("node", F.substring("s", F.col("d") + 1, F.lit(1)).alias("c"))
            .agg(F.max("p").alias("p"), F.max("d").alias("d"), F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")))
    return on_arrow(kids, measured, "node string, c string, p int, d int, n long, lo string, hi string, deep int")


def nodes(edges: DataFrame) -> DataFrame:
    """One row for each node: what lies between it and its parent (``label``),
    the word that ends there, and its edges; a ``leaf`` is the only word there."""
    kid = F.struct("c", F.when(F.col("n") == 1, F.col("lo")).alias("leaf"), "deep")
    return edges.groupBy(F.col("node").alias("at_node")).agg(
        F.max("p").alias("np"), F.max("d").alias("nd"), F.min("lo").alias("prefix"),
        F.max(F.when(F.col("c") == "", F.col("lo"))).alias("term"),
        F.collect_list(F.when(F.col("c") != "", kid)).alias("kids"))


#: From a state at a node to (edge, where its word goes on, edits, the word that ends there).
MOVES = """concat(
  CASE WHEN e = 1 AND spelled AND pos < len THEN transform(filter(kids, k -> k.c = substring(s, pos + 1, 1)), k -> struct(k.c, k.leaf, k.deep, pos + 1 AS at, 1 AS e))
    WHEN e = 0 AND nd < len THEN concat(
      transform(filter(kids, k -> k.c = own AND k.leaf IS NULL), k -> struct(k.c, k.leaf, k.deep, nd + 1 AS at, 0 AS e)),
      CASE WHEN nd >= start THEN concat(
        transform(filter(kids, k -> k.c > own), k -> struct(k.c, k.leaf, k.deep, nd + 1 AS at, 1 AS e)),
        transform(filter(kids, k -> k.c = next AND next <> own), k -> struct(k.c, k.leaf, k.deep, nd + 2 AS at, 1 AS e))) ELSE array() END)
    ELSE array() END,
  CASE WHEN term IS NOT NULL AND (e = 1 AND spelled AND pos = len OR e = 0 AND nd >= start AND nd + 1 = len)
    THEN array(struct('' AS c, term AS leaf, 0 AS deep, len AS at, 1 AS e)) ELSE array() END)"""


def step(frontier: DataFrame, tree: DataFrame) -> DataFrame:
    """The states of the next level, and the neighbours (``near``) found."""
    x = frontier.join(tree, F.col("node") == F.col("at_node"))
    x = x.selectExpr("node", "s", "start", "e", "np", "nd", "prefix", "term", "kids", "char_length(s) AS len", "CASE WHEN e = 1 THEN at + nd - np END AS pos",
                     "substring(s, at + 1, nd - np) = substring(prefix, np + 1, nd - np) AS spelled",
                     "substring(s, nd + 1, 1) AS own", "substring(s, nd + 2, 1) AS next")
    x = x.selectExpr("substring(node, 1, 1) AS side", "s", "start", "nd", "prefix", f"explode({MOVES}) AS m")
    x = x.where("m.leaf IS NULL OR m.e = 1 AND substring(m.leaf, nd + 2) = substring(s, m.at + 1)")
    return x.selectExpr("side", "s", "m.leaf AS near", "CASE WHEN m.leaf IS NULL THEN concat(side, substring(prefix, 1, nd), m.c) END AS node",
                        "m.at AS at", "m.e AS e", "start", "nd + 1 AS p", "m.deep AS d")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near), both ways, of all pairs of words one edit apart."""
    spark = words.sparkSession
    folder = scratch(spark)
    half = F.floor(F.char_length("word") / 2).cast("int")
    sides = [words.select(F.lit(side).alias("side"), s.alias("s"), start.alias("start"))
             for side, s, start in (("f", F.col("word"), half), ("r", F.reverse("word"), F.char_length("word") - half))]
    frontier = sides[0].union(sides[1]).select(
        F.concat("side", F.substring("s", 1, ENTRY)).alias("node"), "s", F.lit(ENTRY).alias("at"), F.lit(0).alias("e"), "start",
        F.lit(ENTRY).alias("p"), F.lit(ENTRY).alias("d"))
    found, level = None, 0
    while True:
        tree = nodes(stored(edges(frontier), folder, f"edges{level}"))
        moved = stored(step(frontier, tree), folder, f"level{level}")
        dropped(spark, folder, f"edges{level}")
        here = moved.where("near IS NOT NULL").select("side", "s", "near")
        found = here if found is None else found.union(here)
        frontier = moved.where("near IS NULL").drop("side", "near")
        if frontier.isEmpty():
            break
        level += 1
    back = lambda c: F.when(F.col("side") == "r", F.reverse(c)).otherwise(F.col(c))
    pairs = found.select(back("s").alias("word"), back("near").alias("near"))
    return pairs.union(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


# ---- forms -----------------------------------------------------------------

def ends_of(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the end of the chain of forms."""
    folder, k = scratch(forms.sparkSession), 0
    now = stored(forms.select("word", F.col("form").alias("root")), folder, "roots0")
    while True:
        k += 1
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = stored(now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), folder, f"roots{k}")
        going, now = now.where("moved"), now.drop("moved")
        if going.isEmpty():
            return now


def variants(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word."""
    spark = df.sparkSession
    folder = scratch(spark)
    known = stored(words(df, key, text), folder, "words")
    near = neighbours(known).join(known.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("b"))
    out = known.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                  F.when(-F.col("b.m") >= TIMES * F.col("n"), F.struct(F.col("b.near").alias("form"), (-F.col("b.m")).alias("n"))).alias("f"))
    out = stored(out.select("word", F.col("f.form").alias("form"), "n", "n_near", F.col("f.n").alias("form_n")), folder, "forms")
    roots = ends_of(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE bits AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
counted AS (SELECT id, w, count(*) AS n, hex(encode(id || ':' || w)) AS x FROM runs WHERE length(w) >= {MIN_LETTERS} GROUP BY id, w),
summed AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h FROM counted, bits),
spelt AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) + 2 AS BIGINT)) ELSE w END AS word, n FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
less AS (SELECT word, length(word) AS len, unnest(range(1, length(word) + 1)) AS i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM words),
pairs AS (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.len = b.len AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.d = b.word UNION SELECT b.word, a.word FROM less a JOIN words b ON a.d = b.word),
best AS (SELECT p.word, near, w.n AS m, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, encode(near)) AS k
  FROM pairs p JOIN words w ON w.word = p.near),
forms AS (SELECT w.word, CASE WHEN m >= {TIMES} * w.n THEN near END AS form, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN m >= {TIMES} * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND k = 1),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)"""
