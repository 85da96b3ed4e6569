"""Quality rules with adaptive thresholds.

Each language and source gets its own upper limits, read from quantile sketches of four integer measures. A sketch counts rows by
bucket (exact below 2048, relative error 1/1024 above), so sketches merge by adding counts, in any order, with equal results.

A limit is the median plus SPREAD times the distance from the lower quartile to the median: junk lies above both, so a group's own junk
moves neither until it is nearly half of the group. Limits shrink smoothly: a group's is averaged with its language's, and that with the
one of all documents, by the number of texts that each sketch counts, PRIOR against it. No group is too small and none falls back.
Only DataFrame functions: no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, materialize, words_column

#: Base rule: fewer words fail, and a larger share (percent) of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: measure -> SPREAD of its limit. Ten-thousandths of a text's visible characters that are neither letters nor numbers; hundredths of a
#: character per word; thousandths of lines that repeat, and of words in repeated windows. The last two are measured where they are not 0.
MEASURES = {"other_share": 16, "word_length": 16, "dup_line_share": 5, "repeat_share": 16}
#: The distance to the quartile counts as so many units at least: a group of equal texts has none.
LEAST = 5
#: Texts that the language's limit counts as in a group's, and the limit of all documents in a language's.
PRIOR = 100
#: Up to so many groups, the table of limits is broadcast (a few hundred kB); beyond, it is joined by a shuffle.
BROADCAST_GROUPS = 5000
#: Buckets are exact below 2 << EXACT.
EXACT = 10

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words found twice or more, the first included."""
    hashes = F.slice(F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, WINDOW)])), 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = _let(ranked, lambda s: F.filter(s, lambda e, k: e["h"].eqNullSafe(F.get(s, k - 1)["h"]) | e["h"].eqNullSafe(F.get(s, k + 1)["h"])))
        starts = F.sort_array(F.transform(twice, lambda e: e["p"]))
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` (a column text and any others) with the columns COUNTS and MEASURES in place of the text. Null and empty texts count
    nothing; a measure is null where a text has nothing to measure."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = rows.withColumn("__words", words_column(F.col("text")))
    words = F.col("__words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = cut.withColumns(
        {
            "n_words": F.size(words).cast("bigint"),
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("bigint"),
            "__others": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D\p{L}\p{N}]+", "")).cast("bigint"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
            "__lines": F.size(lines).cast("bigint"),
            "n_repeat_words": repeat_words(words),
        }
    )
    of = lambda a, b, unit, where: F.when(F.col(where) > 0, F.expr(f"{a} * {unit} div greatest({b}, 1L)"))
    shares = {
        "other_share": of("__others", "word_chars", 10000, "n_words"),
        "word_length": of("word_chars", "n_words", 100, "n_words"),
        "dup_line_share": of("n_dup_lines", "__lines", 1000, "n_dup_lines"),
        "repeat_share": of("n_repeat_words", "n_words", 1000, "n_repeat_words"),
    }
    return counted.withColumns(shares).drop("text", "__words", "__lines", "__others")


def bucket(value: str) -> Column:
    shift = f"(length(bin({value})) - {EXACT + 1})"
    half = 1 << EXACT
    return F.expr(f"CASE WHEN {value} < {2 * half} THEN cast({value} AS INT) ELSE cast({2 * half} + ({shift} - 1) * {half} + shiftright({value}, {shift}) - {half} AS INT) END")


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the rows that pass the base rule: one pass, summed in each task before the shuffle."""
    named = F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m))])
    long = rows.where(~base_failed()).select("lang", "source", F.explode(named).alias("measure", "value")).where("value IS NOT NULL")
    return long.withColumn("bucket", bucket("value")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def limits_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """For each value of ``keys``, from merged sketches: n_ (texts counted) and max_ (the limit) of each measure."""
    merged = counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("docs", F.sum("n").over(group))
    half = 1 << EXACT
    value = F.expr(f"CASE WHEN bucket < {2 * half} THEN bucket ELSE ({half} + (bucket - {2 * half}) % {half}) * cast(pow(2, (bucket - {2 * half}) div {half} + 1) AS BIGINT) END")
    at = lambda q: F.min(F.when(F.col("upto") >= F.expr(f"(docs * {q} + 99) div 100"), value)).cast("bigint")
    quantiles = ranked.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), at(50).alias("mid"), at(25).alias("low"))
    spread = F.coalesce(*[F.when(F.col("measure") == m, F.lit(v)) for m, v in MEASURES.items()])
    limit = quantiles.withColumn("limit", F.col("mid") + F.greatest(F.col("mid") - F.col("low"), F.lit(LEAST)) * spread)
    of = lambda c, m: F.max(F.when(F.col("measure") == m, F.col(c)))
    return limit.groupBy(*keys).agg(*[of("docs", m).alias(f"n_{m}") for m in MEASURES], *[of("limit", m).alias(f"max_{m}") for m in MEASURES])


def limits(counts: DataFrame) -> DataFrame:
    """The limits of each (lang, source) of a sketch. Null is a value as others are. A measure that no text of a group has takes the
    language's limit, one that none of the language has that of all documents."""
    renamed = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    own = limits_of(counts, ["lang", "source"])
    lang = renamed(limits_of(counts, ["lang"]), "l")
    every = renamed(limits_of(counts.withColumn("every", F.lit(1)), ["every"]), "a")
    both = own.join(lang, own["lang"].eqNullSafe(lang["l_lang"]), "left").join(every, F.lit(1) == F.col("a_every"), "left")

    def shrunk(m: str) -> Column:
        mean = lambda n, a, b: f"coalesce(({n} * {a} + {PRIOR} * {b}) div ({n} + {PRIOR}), {b})"
        return F.expr(mean(f"n_{m}", f"max_{m}", mean(f"l_n_{m}", f"l_max_{m}", f"a_max_{m}"))).alias(f"max_{m}")

    return both.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *map(shrunk, MEASURES))


def judged(rows: DataFrame) -> DataFrame:
    """Add base_failed and kept to measured rows, which are read twice: pass a table, not a plan over texts."""
    table = materialize(limits(sketch(rows)))
    if table.count() <= BROADCAST_GROUPS:
        table = F.broadcast(table)
    joined = rows.join(table, rows["lang"].eqNullSafe(F.col("__lang")) & rows["source"].eqNullSafe(F.col("__source")), "left")
    over = F.lit(False)
    for m in MEASURES:
        over = over | F.coalesce(F.col(m) > F.col(f"max_{m}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~over)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept for each row. Null lang or source is a group of its own; null and empty texts fail the base
    rule; repeated rows, null ids stay, each counted; a very long text is one row as others are; an empty table gives none. Other
    columns, whatever their names, are left out."""
    rows = materialize(measured(docs.select("doc_id", "text", "lang", "source")))
    return judged(rows).select("doc_id", *COUNTS, "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns, whatever their names. Null and empty texts go (they fail the base
    rule); repeated rows and null ids are judged row by row; an empty table gives none."""
    rows = materialize(measured(docs.select(F.struct(*columns_of(docs)).alias("__doc"), "text", "lang", "source")))
    return judged(rows).where("kept").select("__doc.*")


#: ``docs`` stands for the table's name.
MEASURED_SQL = r"""
t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM docs),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2, 3, 4]) AS p FROM dup) GROUP BY doc_id),
c AS (SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[\x20\x09-\x0D\p{L}\p{N}]+', '', 'g'))::BIGINT AS n_others,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
  len(ln)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, CASE WHEN n_words > 0 THEN n_others * 10000 // greatest(word_chars, 1) END AS other_share, CASE WHEN n_words > 0 THEN word_chars * 100 // greatest(n_words, 1) END AS word_length,
  CASE WHEN n_dup_lines > 0 THEN n_dup_lines * 1000 // greatest(n_lines, 1) END AS dup_line_share, CASE WHEN n_repeat_words > 0 THEN n_repeat_words * 1000 // greatest(n_words, 1) END AS repeat_share,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c)"""


def _limits_sql(name: str, keys: str) -> str:
    on = keys + ", " if keys else ""
    spread = " ".join(f"WHEN '{m}' THEN {v}" for m, v in MEASURES.items())
    columns = ", ".join([f"max(docs) FILTER (measure = '{m}') AS n_{m}" for m in MEASURES] + [f"max(lim) FILTER (measure = '{m}') AS max_{m}" for m in MEASURES])
    half = 1 << EXACT
    return f"""
{name}_m AS (SELECT {on}measure, bucket, sum(n)::BIGINT AS n FROM sk GROUP BY {on}measure, bucket),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {on}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {on}measure) AS docs,
  CASE WHEN bucket < {2 * half} THEN bucket ELSE ({half} + (bucket - {2 * half}) % {half}) * pow(2, (bucket - {2 * half}) // {half} + 1)::BIGINT END AS v FROM {name}_m),
{name}_q AS (SELECT {on}measure, max(docs) AS docs, min(v) FILTER (upto >= (docs * 50 + 99) // 100) AS mid, min(v) FILTER (upto >= (docs * 25 + 99) // 100) AS low
  FROM {name}_r GROUP BY {on}measure),
{name}_l AS (SELECT *, mid + greatest(mid - low, {LEAST}) * CASE measure {spread} END AS lim FROM {name}_q),
{name} AS (SELECT {on}{columns} FROM {name}_l {"GROUP BY " + keys if keys else ""})"""


def _shrunk_sql(m: str) -> str:
    mean = lambda n, a, b: f"coalesce(({n} * {a} + {PRIOR} * {b}) // ({n} + {PRIOR}), {b})"
    return mean(f"o.n_{m}", f"o.max_{m}", mean(f"l.n_{m}", f"l.max_{m}", f"a.max_{m}")) + f" AS max_{m}"


JUDGED_SQL = (
    f"sk AS (SELECT lang, source, measure, CASE WHEN v < {2 << EXACT} THEN v ELSE {2 << EXACT} + (length(bin(v)) - {EXACT + 2}) * {1 << EXACT} + (v >> (length(bin(v)) - {EXACT + 1})) - {1 << EXACT} END AS bucket, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM m WHERE NOT base_failed AND {m} IS NOT NULL" for m in MEASURES)
    + ") GROUP BY ALL),"
    + ",".join((_limits_sql("own", "lang, source"), _limits_sql("bylang", "lang"), _limits_sql("every", "")))
    + f""",
lim AS (SELECT o.lang, o.source, {", ".join(map(_shrunk_sql, MEASURES))} FROM own o LEFT JOIN bylang l ON o.lang IS NOT DISTINCT FROM l.lang, every a),
judged AS (SELECT m.*, NOT base_failed AND NOT ({" OR ".join(f"coalesce(m.{x} > lim.max_{x}, FALSE)" for x in MEASURES)}) AS kept
  FROM m LEFT JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source)"""
)

ORACLE_SQL = f"WITH docs AS (SELECT * FROM documents),{MEASURED_SQL},\n{JUDGED_SQL}\nSELECT doc_id, {', '.join(COUNTS)}, base_failed, kept FROM judged"
