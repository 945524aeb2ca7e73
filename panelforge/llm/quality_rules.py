"""Quality rules by distribution divergence, in DataFrame functions only.

A document is held against its language: Jensen-Shannon distance between its character-class
histogram and the one that the documents of its language past the base rules have together, and the same for the
language's common words. How far is too far comes from the distances themselves: short documents
stray further than long ones, so each language and length class has limits of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import SPACE, written

#: The most frequent function words by language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
UNKNOWN = "und"
#: Character classes as regular expressions that Java and RE2 read alike; white space is counted
#: apart, and what is left (lower case and letters without case) is the last class.
CLASSES = {
    "upper": r"[\p{Lu}]",
    "digit": r"[0-9]",
    "stop": r"[.,;:!?'\"()-]",
    "symbol": r"[#*$%&|<>=+~^_@/{}\[\]\\]",
}
SYMBOLS = "[#*$%&|<>]"
#: Trimmed from a word before it is held against the common words.
PUNCTUATION = ".,;:!?\"()"
LONGEST = max(len(w) for words in COMMON.values() for w in words)
BASE_WORDS, REPEAT_PERCENT = 50, 50
#: Length classes begin at these numbers of words.
LENGTHS = (100, 200, 500)
#: A limit is the upper quartile of a class plus SPREAD times the distance between its quartiles, or
#: plus the least margin where that is more. Quartiles stand still until a quarter of a class is junk.
QUARTILES, SPREAD = (0.25, 0.75), 1.5
CHAR_MARGIN, WORD_MARGIN = 0.06, 0.05
#: A class of fewer distinct documents takes the limits of its length over all languages.
MIN_CLASS = 30
ALL = "*"


def _jsd(p: list[Column], q: list[Column]) -> Column:
    """Distance in 0..1: the root of the base-2 divergence of two share vectors."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    total = sum((term(a, b) + term(b, a) for a, b in zip(p, q, strict=True)), F.lit(0.0))
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _counts(docs: DataFrame) -> DataFrame:
    """Adds n_words ... n_repeat_words and the two histograms as columns named __*."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.col("lang").isin(list(COMMON))
    d = docs.select("doc_id", text.alias("__t"), F.when(known, F.col("lang")).otherwise(UNKNOWN).alias("__lang"))
    d = d.withColumn("__w", F.array_remove(F.split("__t", SPACE), ""))
    d = d.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("__l", _list_of("__lang"))
    trimmed = F.filter(F.transform("__w", lambda x: F.btrim(F.lower(x), F.lit(PUNCTUATION))), lambda x: F.length(x) <= LONGEST)
    d = d.withColumn("__c", F.array_remove(F.transform(trimmed, lambda x: F.array_position("__l", x).cast("int")), 0))
    d = d.withColumn("__n", F.length("__t").cast("double")).withColumn("word_chars", F.length(F.regexp_replace("__t", SPACE, "")).cast("long"))
    d = d.select(
        "doc_id", "__lang", "__w", "__c",
        F.size("__w").cast("long").alias("n_words"),
        "word_chars",
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "__n",
        (F.col("__n") - F.col("word_chars")).alias("__k_space"),
        *[F.regexp_count("__t", F.lit(r)).cast("double").alias(f"__k_{c}") for c, r in CLASSES.items()],
    )
    # Every 3-word window as (hash, position), sorted: equal windows stand side by side.
    start = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get("__w", i)
    d = d.withColumn("__x", F.transform(start, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
    pairs = F.transform("__x", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    d = d.withColumn("__g", F.when(F.size(F.array_distinct("__x")) < F.size("__x"), F.sort_array(pairs)).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    twin = lambda x, i: (F.get("__g", i - 1)["h"] == x["h"]) | (F.get("__g", i + 1)["h"] == x["h"])
    d = d.withColumn("__p", F.sort_array(F.transform(F.filter("__g", twin), lambda x: x["p"])))
    steps = F.transform("__p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__p", i + 1) - p, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x))
    hits = [(F.size("__c") - F.size(F.array_remove("__c", j + 1))).cast("double").alias(f"__h_{j}") for j in range(12)]
    return d.select("doc_id", "__lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__n", "__k_space", *[f"__k_{c}" for c in CLASSES], *hits)


def _list_of(lang: str) -> Column:
    out = F.array(*[F.lit(w) for w in COMMON["en"]])
    for name, words in COMMON.items():
        out = F.when(F.col(lang) == name, F.array(*[F.lit(w) for w in words])).otherwise(out)
    return out


def _limits(d: DataFrame) -> DataFrame:
    """(__lang, __class, __char_limit, __word_limit); language * stands for all of them.

    Equal distances are copies and count once; quartiles are over four decimals, so that a class
    holds at most 10,000 values at any size.
    """
    rows = d.where("not __base").select("__lang", "__class", F.round("char_distance", 6).alias("c"), F.round("word_distance", 6).alias("w")).distinct()
    rows = rows.withColumn("__lang", F.explode(F.array("__lang", F.lit(ALL))))
    at = lambda x: F.percentile(F.round(x, 4), F.array(*map(F.lit, QUARTILES)))
    q = rows.groupBy("__lang", "__class").agg(F.count("*").alias("__n_class"), at("c").alias("c"), at("w").alias("w"))
    limit = lambda x, least: F.col(x)[1] + F.greatest(F.lit(least), SPREAD * (F.col(x)[1] - F.col(x)[0]))
    return q.where(F.col("__n_class") >= MIN_CLASS).select("__lang", "__class", limit("c", CHAR_MARGIN).alias("__char_limit"), limit("w", WORD_MARGIN).alias("__word_limit"))


def quality_rules(docs: DataFrame, max_char_distance: float = 0.26, max_word_distance: float = 0.3, min_char_words: int = 50, min_word_words: int = 50) -> DataFrame:
    """One row per document: counts, both distances, base_failed and kept.

    A document is kept if it passes the base rules and neither distance is over the limit of its
    language and length class; max_char_distance and max_word_distance are ceilings of these limits,
    and the limits themselves where too few documents are there to derive any.

    The language reference is summed over all documents of a language that pass the base rules (a
    language without a word list, and null, counts as one more language), so the broadcast table has five rows at any size.
    Null text is an empty text: no words, base_failed, not kept. A null doc_id is carried along,
    repeated rows give repeated rows, an empty table gives none, other columns are ignored. Very
    long texts stay in their row; the only sort is over the positions of one document.
    """
    d = written(_counts(docs), "counts")
    hist = ["__k_space"] + [f"__k_{c}" for c in CLASSES] + [f"__h_{j}" for j in range(12)]
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    d = d.withColumn("__base", base)
    ref = d.where("not __base").groupBy("__lang").agg(*[F.sum(c).alias(f"__r{c}") for c in ["__n", *hist]], F.sum("n_words").alias("__rw"))
    d = d.join(F.broadcast(ref), "__lang", "left")

    def shares(cols: list[str], total: str, pre: str = "") -> list[Column]:
        own = [F.try_divide(F.col(f"{pre}{c}"), F.col(total)) for c in cols]
        own = [F.coalesce(x, F.lit(0.0)) for x in own]
        return [*own, F.greatest(F.lit(0.0), 1 - sum(own, F.lit(0.0)))]

    chars, words = hist[: len(CLASSES) + 1], hist[len(CLASSES) + 1 :]
    d = d.withColumn("char_distance", _jsd(shares(chars, "__n"), shares(chars, "__r__n", "__r")))
    d = d.withColumn("word_distance", _jsd(shares(words, "n_words"), shares(words, "__rw", "__r")))
    d = d.withColumn("__class", sum(((F.col("n_words") >= n).cast("int") for n in LENGTHS), F.lit(0)))
    limits = _limits(d)
    overall = limits.where(F.col("__lang") == ALL).select("__class", F.col("__char_limit").alias("__char_all"), F.col("__word_limit").alias("__word_all"))
    d = d.join(F.broadcast(limits), ["__lang", "__class"], "left").join(F.broadcast(overall), "__class", "left")

    def over(kind: str, ceiling: float, words: int) -> Column:
        limit = F.least(F.lit(ceiling), F.coalesce(f"__{kind}_limit", f"__{kind}_all"))
        return (F.col("n_words") >= words) & (F.round(f"{kind}_distance", 6) > F.round(limit, 6))

    far = over("char", max_char_distance, min_char_words) | over("word", max_word_distance, min_word_words)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("__base").alias("base_failed"), (~F.col("__base") & ~far).alias("kept"), F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def oracle(max_char_distance: float = 0.26, max_word_distance: float = 0.3, min_char_words: int = 50, min_word_words: int = 50) -> str:
    """The same rules as DuckDB SQL over the view documents."""
    quote = lambda r: "'" + r.replace("'", "''") + "'"
    hist = ["__k_space", *[f"__k_{c}" for c in CLASSES], *[f"__h_{j}" for j in range(12)]]
    chars, words = hist[: len(CLASSES) + 1], hist[len(CLASSES) + 1 :]

    def jsd(cols: list[str], own_total: str, ref_total: str) -> str:
        p = [f"coalesce({c} / nullif({own_total}, 0), 0.0)" for c in cols]
        q = [f"coalesce(r{c} / nullif({ref_total}, 0), 0.0)" for c in cols]
        p.append(f"greatest(0.0, 1 - ({' + '.join(p)}))")
        q.append(f"greatest(0.0, 1 - ({' + '.join(q)}))")
        terms = [f"CASE WHEN {a} > 0 THEN ({a}) * log2(2 * ({a}) / (({a}) + ({b}))) ELSE 0 END" for x, y in zip(p, q, strict=True) for a, b in ((x, y), (y, x))]
        return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0))"

    lists = " ".join(f"WHEN lang = '{k}' THEN {_sql_list(v)}" for k, v in COMMON.items())
    quartiles = ", ".join(f"quantile_cont(round({x}, 4), {p}) AS {x}{k}" for x in "cw" for k, p in zip((1, 3), QUARTILES, strict=True))
    space = r"'[\x20\x09-\x0D]+'"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({", ".join("'" + k + "'" for k in COMMON)}) THEN lang ELSE '{UNKNOWN}' END AS l,
         CASE {lists} ELSE {_sql_list(COMMON["en"])} END AS common FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, {space}), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, i, ws[i] || chr(1) || ws[i+1] || chr(1) || ws[i+2] AS tri FROM w, unnest(generate_series(1, len(ws) - 2)) AS s(i)),
g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM g),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM g2, unnest([0, 1, 2]) AS o(k) WHERE n > 1 GROUP BY rid),
h AS (
  SELECT rid, doc_id, l, len(ws)::BIGINT AS n_words, length(regexp_replace(t, {space}, '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, {quote(SYMBOLS)}))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    length(t)::DOUBLE AS n, (length(t) - length(regexp_replace(t, {space}, '', 'g')))::DOUBLE AS __k_space,
    {", ".join(f"len(regexp_extract_all(t, {quote(r)}))::DOUBLE AS __k_{c}" for c, r in CLASSES.items())},
    {", ".join(f"len(list_filter(ws, lambda x: trim(lower(x), {quote(PUNCTUATION)}) = common[{j + 1}]))::DOUBLE AS __h_{j}" for j in range(12))}
  FROM w),
r AS (SELECT l, sum(n) AS rn, sum(n_words)::DOUBLE AS rw, {", ".join(f"sum({c}) AS r{c}" for c in hist)} FROM h LEFT JOIN rep USING (rid)
  WHERE n_words >= {BASE_WORDS} AND 100 * coalesce(n_repeat_words, 0) <= {REPEAT_PERCENT} * n_words GROUP BY l),
z AS (SELECT h.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, {jsd(chars, "n", "rn")} AS char_distance, {jsd(words, "n_words", "rw")} AS word_distance FROM h LEFT JOIN r USING (l) LEFT JOIN rep USING (rid)),
y AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  {" + ".join(f"(n_words >= {n})::INTEGER" for n in LENGTHS)} AS class FROM z),
e AS (SELECT DISTINCT l, class, round(char_distance, 6) AS c, round(word_distance, 6) AS w FROM y WHERE NOT base_failed),
q AS (SELECT CASE WHEN grouping(l) = 1 THEN '{ALL}' ELSE l END AS l, class, count(*) AS members, {quartiles} FROM e GROUP BY GROUPING SETS ((l, class), (class))),
m AS (SELECT l, class, c3 + greatest({CHAR_MARGIN}, {SPREAD} * (c3 - c1)) AS char_limit, w3 + greatest({WORD_MARGIN}, {SPREAD} * (w3 - w1)) AS word_limit FROM q WHERE members >= {MIN_CLASS}),
k AS (SELECT y.*, least({max_char_distance}, coalesce(m.char_limit, a.char_limit)) AS char_limit, least({max_word_distance}, coalesce(m.word_limit, a.word_limit)) AS word_limit
  FROM y LEFT JOIN m ON m.l = y.l AND m.class = y.class LEFT JOIN m AS a ON a.l = '{ALL}' AND a.class = y.class)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ((n_words >= {min_char_words} AND round(char_distance, 6) > round(char_limit, 6)) OR (n_words >= {min_word_words} AND round(word_distance, 6) > round(word_limit, 6))) AS kept,
  round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM k"""
