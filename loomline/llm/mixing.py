"""Mixing sources to target weights: whole epochs, then a weighted sample without replacement (Efraimidis and Spirakis).

A document's key is u ** (1 / weight), which orders documents as -log(u) / weight does, its exponential; in each source, exponentials
ascend and sizes are summed until the source's budget is met. The sums run over cells of exponentials first and over the rows of one cell
a source then, so no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, materialize, words_column
from .rules import SPACES, SYMBOLS

#: Sources by code point weigh this, repeating; all sources share so many hundredths of all sizes; no source exceeds so many epochs.
WEIGHTS, SHARE_PERCENT, MAX_EPOCHS, SEED = (3, 1, 2), 150, 2, "mix-1"
#: Rows of a cell aimed at, and most cells of a source.
CELL_ROWS, MAX_CELLS = 200, 1 << 20
BROADCAST_SOURCES = 5000


def keyed(docs: DataFrame) -> DataFrame:
    """Add __skey (source, never null), __size (words), __key and __tie. The quality weight of a text is the share of its visible
    characters that are not symbols, at least 0.05; empty and null texts weigh 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    visible = F.length(F.translate(text, SPACES, ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    weight = F.when(visible > 0, F.greatest(1 - symbols / visible, F.lit(0.05))).otherwise(F.lit(1.0))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text))  # rows that repeat an id, or have none, draw by their texts
    u = (F.conv(F.substring(F.md5(F.concat(name, F.lit(":" + SEED))), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
    return docs.withColumns(
        {
            "__skey": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")),  # t: null comes last
            "__size": F.size(words_column(F.col("text"))).cast("bigint"),
            "__key": -F.log(u) / weight,
            "__tie": F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")),
        }
    )


def targets(sizes: DataFrame) -> DataFrame:
    """__skey, source_size, target from (__skey, source_size), a row for each source: weights share the budget; a source that would
    exceed MAX_EPOCHS times its size stops there, and what is over is shared by weight again."""
    numbered = sizes.withColumn("__w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(W.orderBy("__skey")) - 1) % len(WEIGHTS) + 1).cast("bigint"))
    by = W.orderBy(F.col("source_size") / F.col("__w"), "__skey")
    ranked = numbered.withColumns(
        {
            "__all": F.sum("source_size").over(W.partitionBy()),
            "__before": F.coalesce(F.sum("source_size").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "__rest": F.sum("__w").over(by.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    # In integers: what is left of the budget after the capped sources, times 100, over the weights of the rest.
    ranked = ranked.withColumn("__left", SHARE_PERCENT * F.col("__all") - 100 * MAX_EPOCHS * F.col("__before"))
    ranked = ranked.withColumn("__capped", 100 * MAX_EPOCHS * F.col("source_size") * F.col("__rest") <= F.col("__w") * F.col("__left"))
    level = F.max(F.when(~F.col("__capped"), F.struct(-F.col("__before"), F.col("__rest"), F.col("__left").alias("left"), F.col("__rest").alias("rest")))).over(W.partitionBy())
    ranked = ranked.withColumn("__level", level)
    target = F.when(F.col("__capped") | F.col("__level").isNull(), MAX_EPOCHS * F.col("source_size").cast("double")).otherwise(F.col("__w") * F.col("__level.left") / (100.0 * F.col("__level.rest")))
    return ranked.select("__skey", "source_size", target.alias("target"))


def _cell(cells: int):
    """Cells of equal width of x / (1 + x): at the least weight, a cell has eight times the rows of the mean."""
    return F.floor(F.col("__key") / (1 + F.col("__key")) * cells).cast("bigint")


def cuts(rows: DataFrame) -> tuple[DataFrame, int]:
    """For each source of keyed rows its size, target, whole epochs, the cell where its budget ends and the last row taken there; and
    the number of cells. ``rows`` is read several times: pass a table."""
    sizes = materialize(rows.groupBy("__skey").agg(F.sum("__size").alias("source_size"), F.count("*").alias("n")))
    most = sizes.agg(F.max("n")).first()[0] or 0
    cells = min(MAX_CELLS, 1 << max(4, (most // CELL_ROWS).bit_length()))
    plan = targets(sizes.select("__skey", "source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = materialize(plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    sums = rows.groupBy("__skey", _cell(cells).alias("cell")).agg(F.sum("__size").alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(W.partitionBy("__skey").orderBy("cell")))
    last = upto.join(plan, "__skey").where("upto >= rest").groupBy("__skey").agg(F.min(F.struct("cell", (F.col("upto") - F.col("n")).alias("before"))).alias("c"))
    last = materialize(last.join(plan.select("__skey", "rest"), "__skey").select("__skey", F.col("c.cell").alias("cell"), F.col("c.before").alias("before"), "rest"))
    there = rows.withColumn("cell", _cell(cells)).join(last, ["__skey", "cell"])
    order = W.partitionBy("__skey", "cell").orderBy("__key", "__tie").rowsBetween(W.unboundedPreceding, 0)
    summed = there.withColumn("sum", F.sum("__size").over(order) + F.col("before"))
    taken = summed.where(F.col("sum") - F.col("__size") / 2 < F.col("rest"))  # the last row is taken where that comes nearer to the target
    ends = taken.groupBy("__skey").agg(F.max(F.struct(F.col("__key").alias("k"), F.col("__tie").alias("tie"))).alias("end"))
    found = plan.join(last.select("__skey", "cell"), "__skey", "left").join(ends, "__skey", "left")
    return materialize(found.select(F.col("__skey").alias("__source"), "source_size", "target", "epochs", F.col("cell").alias("__end_cell"), "end")), cells


def with_copies(rows: DataFrame, table: DataFrame, cells: int) -> DataFrame:
    """Add __copies, how often the mix takes a keyed row."""
    table = F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table
    joined = rows.join(table, rows["__skey"] == F.col("__source"), "left")
    at = F.struct(F.col("__key").alias("k"), F.col("__tie").alias("tie"))
    part = (_cell(cells) < F.col("__end_cell")) | ((_cell(cells) == F.col("__end_cell")) & F.coalesce(at <= F.col("end"), F.lit(False)))
    return joined.withColumn("__copies", F.col("epochs") + F.coalesce(part & (F.col("target") > F.col("epochs") * F.col("source_size")), F.lit(False)).cast("bigint"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words) for each row. Null and empty texts have size 0; a null source is a source, the
    last; rows that repeat an id and text are taken together or split at the budget's end; null ids stay. Other columns, whatever their
    names, are left out. An empty table gives none."""
    rows = materialize(keyed(docs.select("doc_id", "text", "source")).drop("text", "source"))
    table, cells = cuts(rows)
    mixed = with_copies(rows, table, cells)
    return mixed.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__copies") * F.col("__size")).alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns, whatever their names. Null and empty texts have size 0 and
    come as often as their source's whole epochs; a null source is a source, the last; null ids and repeated rows draw by their texts. An
    empty table gives none."""
    inner = docs.select(F.struct(*columns_of(docs)).alias("__doc"), "doc_id", "text", "source")
    table, cells = cuts(materialize(keyed(inner.drop("__doc")).drop("text", "source")))
    copies = with_copies(keyed(inner).drop("text"), table, cells)
    return copies.select("__doc", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))).select("__doc.*")


#: Over a table ``docs``; ends in a table ``mixed`` of the result and copies.
MIXED_SQL = r"""
k AS (SELECT *, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS visible,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS symbols,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(t) || ':mix-1'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM (SELECT *, coalesce(text, '') AS t FROM docs)),
kk AS (SELECT *, -ln(u) / (CASE WHEN visible > 0 THEN greatest(1 - symbols / visible, 0.05::DOUBLE) ELSE 1.0::DOUBLE END) AS key, coalesce('s' || source, 't') AS sk FROM k),
s AS (SELECT sk, sum(size)::BIGINT AS source_size FROM kk GROUP BY sk),
s1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
s2 AS (SELECT *, (150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rem,
  (sum(w) OVER (ORDER BY source_size / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest, row_number() OVER (ORDER BY source_size / w, sk) AS rn FROM s1),
s3 AS (SELECT *, 200 * source_size * rest <= w * rem AS capped FROM s2),
lv AS (SELECT rem, rest FROM s3 WHERE NOT capped ORDER BY rn LIMIT 1),
tg AS (SELECT sk, source_size, CASE WHEN capped THEN 2 * source_size::DOUBLE ELSE w * (SELECT rem FROM lv) / (100.0::DOUBLE * (SELECT rest FROM lv)) END AS target FROM s3),
pl AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM tg),
ps AS (SELECT kk.*, pl.source_size, pl.target, pl.epochs, sum(size) OVER (PARTITION BY sk ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM kk JOIN pl USING (sk)),
mixed AS (SELECT doc_id, text, lang, source, n_chars, size, source_size, target, epochs + (target > epochs * source_size AND upto - size / 2 < target - epochs * source_size)::BIGINT AS copies FROM ps)"""

ORACLE_SQL = f"WITH docs AS (SELECT * FROM documents),{MIXED_SQL}\nSELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"
