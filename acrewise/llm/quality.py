"""Op 5, quality rules by distribution divergence (DataFrame only).

Each document gives two histograms: characters by class, and the common words
of its language (one cell a word, one for all other words). Each language's
reference is the median of each cell's share over the language's distinct
texts, taken over the whole table: a text counts once however often it is
copied and however long it is, so neither copies nor long texts move the
reference. A document is rejected when the Jensen-Shannon distance (base 2, 0
to 1) from its language's reference passes a limit. A histogram of fewer than
the guard's characters or words is too noisy to judge and passes; it takes no
part in the reference either.

The counts are taken in one pass over the texts and stored as a narrow table;
references and verdicts read that table only. References are one row a
language. Shares are rounded to ``STEPS`` parts, so a median is taken from at
most that many counted values.

Defined cases: null and empty texts have no words and fail the base rule; a
null language is a language of its own, and languages without a word list are
judged by characters alone; equal rows get equal verdicts; very long texts
stay one row; an empty table gives an empty result. A language of one distinct
text is its own reference and is not rejected by distance; one whose medians
are all zero has no centre and is not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrewise.llm.common import BLANK, WORD, fixed, matching, row_key, scratch, stored, table, words

MIN_WORDS = 50          # base rule
REPEAT_PCT = 50         # base rule
MIN_CHARS = 200         # guard of the character histogram
MIN_COMMON_WORDS = 100  # guard of the word histogram
MAX_CHAR_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.25
STEPS = 10_000          # parts that shares are rounded to for the medians

# Frequent words of each language.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "he"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a"],
}
# Character classes, each taken from what the ones before it have left.
CLASSES = ["a-z", r"\x20\x09-\x0D", "A-Z", "0-9", r".,;:!?'\"()-", r"#*$%&|<>"]


def common_histogram(line: Column, lang: Column) -> Column:
    """Counts of the language's common words; null
    for a language without a list. ``line`` holds each common word between
    its own pair of spaces, so counting a word is a replace."""
    def count(w: str) -> Column:
        s = f" {w} "
        return ((F.char_length(line) - F.char_length(F.replace(line, F.lit(s), F.lit("")))) / len(s)).cast("long")
    out = F.lit(None).cast("array<long>")
    for name, ws in COMMON.items():
        out = F.when(lang == name, F.array(*[count(w) for w in ws])).otherwise(out)
    return out


def features(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One narrow row per input row: key, counts and histograms.

    Words in repeated windows: the windows' hashes are sorted with their
    positions, equal neighbours are repeats, and the sorted positions of the
    repeats cover min(3, gap) words each. Texts whose window hashes are all
    different skip the sort."""
    known = sorted({w for ws in COMMON.values() for w in ws})
    x = df.select(row_key(df, key, text).alias("k"), F.col(f"`{lang}`").cast("string").alias("lang"),
                  F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    x = fixed(x, w=words(F.col("t")), lines=F.filter(F.split("t", "\n"), lambda y: y.rlike(WORD)))
    x = fixed(x, h=F.transform("w", lambda y: F.xxhash64(y)),
              line=F.concat(F.lit(" "), F.array_join(F.filter(F.transform("w", F.lower), lambda y: y.isin(known)), "  "), F.lit(" ")))
    x = fixed(x, g=F.when(F.size("h") >= 4, F.transform(F.sequence(F.lit(0), F.size("h") - 3), lambda i: F.xxhash64(
        F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    x = fixed(x, runs=F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(
        F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda y, j: F.coalesce(y["g"] == F.get("runs", j)["g"], F.lit(False))
    x = fixed(x, at=F.sort_array(F.transform(F.filter("runs", lambda y, i: same(y, i - 1) | same(y, i + 1)), lambda y: y["i"])))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                          lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))["n"]
    cells, rest = [], "t"
    for n, c in enumerate(CLASSES):
        x = fixed(x, **{f"rest{n}": F.regexp_replace(rest, f"[{c}]+", "")})
        cells.append(F.char_length(rest) - F.char_length(f"rest{n}"))
        rest = f"rest{n}"
    n_words = F.size("w").cast("long")
    x = fixed(x, first=common_histogram(F.col("line"), F.col("lang")))
    return x.select(
        "k", "lang", n_words.alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length(f"rest{len(CLASSES) - 2}") - F.char_length(rest)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*cells, F.char_length(rest)).cast("array<long>").alias("chars"),
        F.concat("first", F.array(n_words - _total(F.col("first")))).alias("common"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def shares(counts: Column) -> Column:
    """A histogram with its total, as shares of one."""
    return F.get(F.transform(F.array(F.struct(counts.alias("c"), _total(counts).alias("n"))),
                             lambda s: F.transform(s["c"], lambda x: F.try_divide(x, s["n"]))), F.lit(0))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two lists of shares."""
    def half(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def references(feats: DataFrame) -> DataFrame:
    """The median share of each cell over the distinct texts of each
    language, in 2 * ``STEPS`` parts (whole numbers). Copies and equal shares
    are counted map-side."""
    texts = feats.select("lang", F.col("k.fp").alias("fp"), "chars", "common").distinct()
    guard = lambda c, least: F.when(_total(F.col(c)) >= least, shares(F.col(c)))
    x = fixed(texts, p_chars=guard("chars", MIN_CHARS), p_common=guard("common", MIN_COMMON_WORDS))
    cells = len(CLASSES) + 1
    none = F.array().cast("array<double>")
    # the cells of both histograms in one list, the common words from ``cells`` on
    both = F.concat(F.transform(F.coalesce("p_chars", none), lambda y, i: F.struct(i.alias("cell"), y.alias("y"))),
                    F.transform(F.coalesce("p_common", none), lambda y, i: F.struct((i + cells).alias("cell"), y.alias("y"))))
    counted = x.select("lang", F.explode(both).alias("c")).groupBy("lang", "c.cell", F.round(F.col("c.y") * STEPS).cast("int").alias("part")).count()
    middle = counted.groupBy("lang", "cell").agg((2 * F.percentile("part", F.lit(0.5), F.col("count"))).cast("long").alias("v"))
    ref = middle.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("cell", "v"))).alias("m"))
    part = lambda of: F.transform(F.filter("m", of), lambda y: y["v"])
    return ref.select("lang", part(lambda y: y["cell"] < cells).alias("ref_chars"), part(lambda y: y["cell"] >= cells).alias("ref_common"))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key struct ``k``, the counts, both distances (null where there is
    nothing to compare), ``base_failed`` and ``kept``."""
    feats = stored(features(df, key, text, lang), scratch(df.sparkSession), "features")
    refs = references(feats).withColumnRenamed("lang", "ref_lang")
    both = feats.join(refs, feats["lang"].eqNullSafe(refs["ref_lang"]), "left")
    both = fixed(both, p_chars=shares(F.col("chars")), q_chars=shares(F.col("ref_chars")),
                 p_common=shares(F.col("common")), q_common=shares(F.col("ref_common")))
    chars = F.when(_total(F.col("chars")) >= MIN_CHARS, js_distance(F.col("p_chars"), F.col("q_chars")))
    common = F.when(_total(F.col("common")) >= MIN_COMMON_WORDS, js_distance(F.col("p_common"), F.col("q_common")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PCT * F.col("n_words"))
    far = F.coalesce(chars > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(common > MAX_WORD_DISTANCE, F.lit(False))
    return both.select("k", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       chars.alias("char_distance"), common.alias("word_distance"),
                       failed.alias("base_failed"), (~failed & ~far).alias("kept"))


def op5(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).select(
        F.col("k.id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(df: DataFrame) -> DataFrame:
    """Pipeline form: the rows that are kept, columns unchanged."""
    return matching(df, row_key(df, "doc_id", "text"), judge(df).where("kept").select("k").distinct())


def _sql_js(p: str, q: str) -> str:
    half = lambda x, o: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {o}) / 2)) ELSE 0.0 END"
    return f"""sqrt(greatest(0.0, list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len({p}) + 1),
      lambda i: {half(f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))")}
              + {half(f"({q}[i] / list_sum({q}))", f"({p}[i] / list_sum({p}))")})), lambda s, x: s + x) / 2))"""


def sql_judge(src: str = "documents") -> str:
    """CTEs ending in ``judged`` (doc_id, text, the counts, base_failed, kept)."""
    rest, cells = "t", []
    for c in CLASSES:
        left = f"regexp_replace({rest}, '[{c.replace(chr(39), chr(39) * 2)}]+', '', 'g')"
        cells.append((rest, left))
        rest = left
    chars = ", ".join([f"length({a}) - length({b})" for a, b in cells] + [f"length({rest})"])
    common = "CASE lang " + " ".join(
        f"WHEN '{k}' THEN [" + ", ".join(f"len(list_filter(lw, lambda x: x = '{w}'))" for w in ws) + "]" for k, ws in COMMON.items()) + " END"
    part = lambda a: f"CAST(round(CAST({a}[cell] AS DOUBLE) / list_sum({a}) * {STEPS}) AS INTEGER)"
    return f"""
q_docs AS (SELECT doc_id, lang, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
    list_transform(w, lambda x: lower(x)) AS lw FROM {src}),
q_rows AS (SELECT row_number() OVER () AS rid, * FROM q_docs),
q_grams AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM q_rows WHERE len(w) >= 3),
q_rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM q_grams) WHERE c >= 2) GROUP BY rid),
q_feat AS (SELECT r.rid, doc_id, lang, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{BLANK}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(q_rep.n, 0) AS BIGINT) AS n_repeat_words, [{chars}] AS chars, {common} AS com0,
    list_append(com0, len(w) - CAST(list_sum(com0) AS BIGINT)) AS com
  FROM q_rows r LEFT JOIN q_rep ON q_rep.rid = r.rid),
q_texts AS (SELECT DISTINCT lang, md5(coalesce(text, '')) AS h, chars, com, com0 IS NOT NULL AS listed FROM q_feat),
q_parts AS (SELECT lang, cell, {part("chars")} AS part FROM (SELECT *, unnest(range(1, len(chars) + 1)) AS cell FROM q_texts WHERE list_sum(chars) >= {MIN_CHARS})
  UNION ALL SELECT lang, 100 + cell, {part("com")} FROM (SELECT *, unnest(range(1, len(com) + 1)) AS cell FROM q_texts WHERE listed AND list_sum(com) >= {MIN_COMMON_WORDS})),
q_middle AS (SELECT lang, cell, CAST(2 * quantile_cont(part, 0.5) AS BIGINT) AS v FROM q_parts GROUP BY lang, cell),
q_ref AS (SELECT lang AS rl, list(v ORDER BY cell) FILTER (WHERE cell < 100) AS rch, list(v ORDER BY cell) FILTER (WHERE cell > 100) AS rco FROM q_middle GROUP BY lang),
q_dist AS (SELECT f.*, CASE WHEN list_sum(chars) >= {MIN_CHARS} THEN {_sql_js("chars", "rch")} END AS dch,
    CASE WHEN com0 IS NOT NULL AND list_sum(com) >= {MIN_COMMON_WORDS} THEN {_sql_js("com", "rco")} END AS dco
  FROM q_feat f LEFT JOIN q_ref ON f.lang IS NOT DISTINCT FROM rl),
judged AS (SELECT rid, doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PCT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PCT} * n_words)
      AND NOT coalesce(dch > {MAX_CHAR_DISTANCE}, false) AND NOT coalesce(dco > {MAX_WORD_DISTANCE}, false) AS kept FROM q_dist)"""


SQL = f"""WITH {sql_judge()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""
