"""Book-trade dumps as live claims: a catalogue of ISBN-10 records with product ids, and a feed of items with several ISBNs.

An ISBN becomes its 13-digit form here, so both sources' claims about a title meet in one code. One pass over the records, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import codes

from .envelope import tagged


@dataclass(frozen=True)
class Feed:
    """``member``: of a dump's document, the list of records; ``ref``, ``isbns``, ``product``: SQL over a record of ``schema``."""

    source: str
    member: str
    schema: str
    ref: str
    isbns: str
    product: str
    fields: tuple[str, ...]


# The two dumps' names and members.
CATALOGUE = Feed("librex", "records", "id bigint, isbn string", "concat('librex-', r.id)", "array(r.isbn)", "r.id", ("title", "pages", "publisher", "binding"))
ITEMS = Feed("bookwire", "items", "sku string, isbns array<string>", "r.sku", "r.isbns", "CAST(NULL AS BIGINT)", ("title", "pages", "imprint"))
SCHEME = "isbn13"


def records(dumps: DataFrame, feed: Feed) -> DataFrame:
    """line: a record's JSON, from whole dumps in a column ``line``. A dump without its member has none; one that is no JSON fails."""
    held = F.from_json("line", f"{feed.member} array<variant>", {"mode": "FAILFAST"})
    return dumps.select(F.explode(held[feed.member]).alias("r")).select(F.to_json("r").alias("line"))


def claims(lines: DataFrame, feed: Feed) -> DataFrame:
    """kind, source, ref, codes, code, product, field, value (STRUCT(t, s)) from records in a column ``line``.

    A record gives an identity claim, a grouping claim where the feed has product ids, and an attribute claim, of its first code, for
    each field that is neither absent, null nor false. An ISBN that fails its checksum, or a record without any, fails the job.
    """
    schema = ", ".join([feed.schema, *(f"{f} variant" for f in feed.fields)])
    read = lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r"))
    read = read.select("r", F.expr(feed.ref).alias("ref"), F.expr(feed.product).alias("product"), F.coalesce(F.expr(feed.isbns), F.array().cast("array<string>")).alias("isbns"))
    spoken = F.transform("isbns", lambda x: F.coalesce(F.concat(F.lit(f"{SCHEME}:"), codes.isbn13(x)), failed("no valid ISBN: ", x)))
    read = read.withColumn("codes", F.when(F.size("isbns") == 0, F.array(failed("no ISBN at all", F.lit("")))).otherwise(spoken))

    def claim(kind: str, field: str | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(feed.source).alias("source"),
            F.col("ref"),
            (F.col("codes") if kind == "identity" else F.lit(None).cast("array<string>")).alias("codes"),
            (F.lit(None).cast("string") if kind == "identity" else F.col("codes")[0]).alias("code"),
            (F.col("product") if kind == "grouping" else F.lit(None).cast("bigint")).alias("product"),
            F.lit(field).cast("string").alias("field"),
            (tagged(F.col(f"r.{field}")) if field else F.lit(None).cast("struct<t: string, s: string>")).alias("value"),
        )

    said = F.array(claim("identity"), claim("grouping"), *(claim("attribute", f) for f in feed.fields))
    rows = read.select(F.inline(said))
    meant = (F.col("value.t") != "n") & ~((F.col("value.t") == "b") & (F.col("value.s") == "false"))
    return rows.where((F.col("kind") == "identity") | F.col("product").isNotNull() | F.coalesce(meant, F.lit(False)))


def failed(what: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(what), F.coalesce(value, F.lit("null")))).cast("string")
