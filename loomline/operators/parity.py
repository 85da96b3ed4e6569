"""Parity with another system's materialised records: snapshots of both in one shape, and every way in which they differ.

A snapshot is a table (entity, lane, name, value, candidates): identity codes, edges, media and descriptions are names without values;
attributes have a tagged value or, where nothing decides between sources, candidates and no value; the lane ``product`` names the keys.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import registry
from loomline.operators import catalog

SETS = ("identity", "edge", "media", "description")
VERSION = "1"
# The parts that a snapshot document must have.
REQUIRED = ("identity", "attributes", "edges", "media", "descriptions")
CLASSES = ("match", "value_mismatch", "unresolved", "engine_only", "applier_only", "cardinality")
SNAPSHOT = "entity bigint, lane string, name string, value string, candidates string"


def snapshot(found: catalog.Catalog, entity_of: DataFrame) -> DataFrame:
    """The snapshot of golden records; entity_of(key, entity) tells whose record a key is. Media and descriptions go by the id that their
    source gave them, or else by their key."""
    nothing = F.lit(None).cast("string")
    row = lambda df, lane, name, value=nothing, candidates=nothing: df.join(entity_of, "key").select("entity", F.lit(lane).alias("lane"), name.alias("name"), value.alias("value"), candidates.alias("candidates"))
    product = found.members.where("lane = 'product'")

    def source_id(rows: DataFrame, column: str, scheme: str) -> DataFrame:
        ids = found.members.where(registry.scheme_of(F.col("code")) == scheme).groupBy(F.col("key").alias(column)).agg(F.min(registry.value_of(F.col("code"))).alias("id"))
        return rows.join(ids, column, "left").withColumn("id", F.coalesce("id", F.when(registry.scheme_of(F.col(column)) == scheme, registry.value_of(F.col(column))), column))

    said = found.attributes.where("lane = 'product'")
    decided = said.where("status <> 'needs_review'")
    options = F.to_json(F.transform("candidates", lambda x: F.concat_ws("=", x["source"].cast("string"), catalog.tagged_text(x["value"]))))
    parts = [
        row(product, "identity", F.col("code")),
        row(product.select("key").distinct(), "product", F.col("key")),
        row(decided, "attribute", F.col("field"), catalog.tagged_text(F.col("value"))),
        row(said.where("status = 'needs_review'"), "attribute", F.col("field"), nothing, options),
        row(found.categories, "edge", F.col("category")),
        row(source_id(found.media.select("key", "asset").union(found.depicted.select("key", "asset")), "asset", "asset_id"), "media", F.col("id")),
        row(source_id(found.descriptions.select("key", "description"), "description", "text_id"), "description", F.col("id")),
    ]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.union(more)
    return whole.distinct()


def compare(engine: DataFrame, applier: DataFrame) -> DataFrame:
    """entity, lane, name, verdict, engine, applier, candidates of every name that either snapshot has. Sets are ``match``, ``engine_only``
    or ``applier_only``; attributes also ``value_mismatch``, and ``unresolved`` where the engine could not decide, whatever the applier
    has; an entity with other than one key is a ``cardinality`` of its own."""
    side = lambda df, name: df.where("lane <> 'product'").select("entity", "lane", "name", F.col("value").alias(name), "candidates", F.lit(True).alias(f"in_{name}"))
    both = side(engine, "engine").join(side(applier, "applier").drop("candidates"), ["entity", "lane", "name"], "full")
    verdict = (
        F.when(F.col("candidates").isNotNull(), "unresolved")
        .when(F.col("in_engine").isNull(), "applier_only")
        .when(F.col("in_applier").isNull(), "engine_only")
        .when(F.col("engine").eqNullSafe(F.col("applier")), "match")
        .otherwise("value_mismatch")
    )
    told = both.select("entity", "lane", "name", verdict.alias("verdict"), "engine", "applier", "candidates")
    keys = engine.groupBy("entity").agg(F.count_if(F.col("lane") == "product").alias("n")).where("n <> 1")
    wrong = keys.select("entity", F.lit("product").alias("lane"), F.lit("variants").alias("name"), F.lit("cardinality").alias("verdict"), F.col("n").cast("string").alias("engine"), F.lit("1").alias("applier"), F.lit(None).cast("string").alias("candidates"))
    return told.unionByName(wrong)


def counts(compared: DataFrame, by_entity: bool = False) -> DataFrame:
    """How often each verdict is given, in all or for each entity; ``clean`` entities differ in nothing."""
    n = [F.count_if(F.col("verdict") == c).alias(c) for c in CLASSES]
    if not by_entity:
        return compared.agg(*n)
    return compared.groupBy("entity").agg(*n).withColumn("clean", sum(F.col(c) for c in CLASSES[1:]) == 0)


def from_documents(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Snapshots from JSON documents (a column ``line``), one an entity. A document of another version, or without one of its parts, fails
    the job: a cohort that cannot be read is never reported as parity."""
    schema = "schema_version string, legacy_entity bigint, identity array<string>, attributes map<string, variant>, edges array<string>, media array<string>, descriptions array<string>"
    read = lines.select("line", F.from_json("line", schema).alias("d"))
    missing = [F.when(F.get_json_object("line", f"$.{n}").isNull(), F.lit(n)) for n in REQUIRED]
    wrong = F.when(~F.col("d.schema_version").eqNullSafe(F.lit(VERSION)), F.lit("unsupported snapshot schema_version")).when(F.size(F.array_compact(F.array(*missing))) > 0, F.concat(F.lit("snapshot is missing "), F.array_join(F.array(*missing), ", ")))
    checked = read.withColumn("d", F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("d"))).select("d.*")
    from loomline.sources.envelope import tagged

    nothing = F.lit(None).cast("string")
    lists = {"identity": "identity", "edges": "edge", "media": "media", "descriptions": "description"}
    whole = checked.select(F.col("legacy_entity").alias("entity"), F.explode("attributes").alias("name", "v")).select("entity", F.lit("attribute").alias("lane"), "name", catalog.tagged_text(tagged(F.col("v"))).alias("value"), nothing.alias("candidates"))
    for column, lane in lists.items():
        whole = whole.union(checked.select(F.col("legacy_entity").alias("entity"), F.lit(lane).alias("lane"), F.explode(column).alias("name"), nothing.alias("value"), nothing.alias("candidates")))
    return whole


def cohort(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The histories and the snapshots of a folder: each ``<stem>.snapshot.json`` with the ``<stem>.json`` beside it. A snapshot without a
    history is an error."""
    whole = spark.read.format("text").option("wholetext", True).load(folder).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    documents = whole.where(F.col("file").endswith(".json"))
    snapshots = documents.where(F.col("file").endswith(".snapshot.json")).withColumn("stem", F.regexp_replace("file", r"\.snapshot\.json$", ""))
    histories = documents.where(~F.col("file").endswith(".snapshot.json")).withColumn("stem", F.regexp_replace("file", r"\.json$", ""))
    alone = snapshots.join(histories, "stem", "left_anti").select("file")
    if not alone.isEmpty():
        raise ValueError(f"a snapshot has no history: {alone.first()[0]}")
    return histories.join(snapshots.select("stem"), "stem", "left_semi").select("line"), snapshots.select("line")


def summary(compared: DataFrame, limit: int = 1000) -> str:
    """The report as text, with the first ``limit`` differences."""
    c, own = counts(compared).first(), counts(compared, True).agg(F.count("*").alias("n"), F.count_if("clean").alias("clean")).first()
    lines = [f"Parity: {own.n} entities, {own.clean} clean, {own.n - own.clean} diverging"] + [f"  {n + ':':<16}{c[n]}" for n in CLASSES]
    for r in compared.where("verdict <> 'match'").orderBy("entity", "lane", "name").limit(limit).collect():
        lines.append(f"  - {r.entity} {r.lane}/{r.name}: {r.verdict} (engine={r.engine}, applier={r.applier})")
    return "\n".join(lines)


def canonical_document(rows: DataFrame, keys: list[str], limit: int = 1_000_000) -> str:
    """Rows as one JSON document whose objects have sorted keys, in the order of ``keys``: the same rows give the same bytes. It is for
    reports; more rows than ``limit`` are an error, and a table is to be written instead."""
    found = rows.orderBy(*keys).limit(limit + 1).toJSON().collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows: write a table")
    return json.dumps([json.loads(x) for x in found], sort_keys=True, ensure_ascii=False, separators=(",", ":"))
