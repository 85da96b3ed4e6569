"""JSON sources: histories of decoded events, raw deltas, snapshots and CSV dumps, all to one flat table of events.

Values keep their JSON type: ``value`` is STRUCT(t, s), t one of s (string), i (integer), f (other number), b, n (null), j (list or map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.registry import IDENTITY_FIELDS

# Fixed values.
VERSION = "1"
OPS = {"1": "set", "2": "add", "3": "remove", "4": "delete"}
KINDS = ("identity", "attribute", "edge", "media")
DROPPED_OPCODE = "update_sources"
DROPPED_FIELDS = ("updatedAt", "updatedBy", "createdAt", "createdBy", "legacyId")
EDGE_FIELDS = r"^(brands|internationalBrands|labos|organizations|\w+Categories)$"
MEDIA_FIELDS = ("media", "descriptions", "leaflets")
MAX_CODE = 160

DELTA = "id bigint, tag string, entity bigint, events array<array<variant>>, created_at bigint, created_by bigint"
EVENT = "recorded_at bigint, valid_from bigint, `by` bigint, tag string, source string, op string, kind string, scheme string, code string, field string, locale string, value variant, collection string, asset variant"
ENVELOPE = f"schema_version string, source_system string, legacy_entity bigint, last_touched_at bigint, dropped_meta_count bigint, events array<struct<{', '.join(x.replace(' ', ': ', 1) for x in EVENT.split(', '))}>>"


def tagged(value: Column) -> Column:
    """STRUCT(t, s) of a variant: 859 and "859" stay different. An absent value is null, a JSON null is (n, '')."""
    kind = F.schema_of_variant(value)
    t = F.when(kind == "STRING", "s").when(kind == "BIGINT", "i").when(kind == "BOOLEAN", "b").when(kind == "VOID", "n").when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "f").otherwise("j")
    text = F.coalesce(F.variant_get(value, "$", "string"), F.lit(""))
    return F.when(value.isNotNull(), F.struct(t.alias("t"), text.alias("s")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: one JSON document a line; blank lines are left out."""
    return spark.read.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")


def deltas_of(lines: DataFrame) -> DataFrame:
    """Raw deltas from a column ``line``. A line that is no JSON object fails the job: a half-read history would resolve wrongly."""
    return lines.select(F.from_json("line", DELTA, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def csv_deltas(spark: SparkSession, path: str) -> DataFrame:
    """Raw deltas from a CSV dump with a header and the columns id, tag, entity, events (quoted JSON, quotes doubled), created_at, created_by."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    events = F.from_json("events", "array<array<variant>>", {"mode": "FAILFAST"})
    return rows.select(F.col("id").cast("bigint"), "tag", F.col("entity").cast("bigint"), events.alias("events"), F.col("created_at").cast("bigint"), F.col("created_by").cast("bigint"))


def snapshot_deltas(lines: DataFrame) -> DataFrame:
    """One delta for each snapshot line {entity, at, sources: {org: {fields: {name: value}, collections: {name: [value]}}}}: what is true
    now as if it had been set at once. A name may carry a locale (``name:fr``)."""
    schema = "entity bigint, at bigint, sources map<string, struct<fields: map<string, variant>, collections: map<string, array<variant>>>>"
    s = lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("s")).select("s.*")

    def event(op: str, key: Column, value: Column) -> Column:
        return F.array(F.to_variant_object(F.array(F.lit(op))), F.to_variant_object(F.array(key)), value)

    def unboxed(e: Column) -> Column:
        return F.array(F.variant_get(e[0], "$[0]", "variant"), F.variant_get(e[1], "$[0]", "variant"), e[2])

    def of_source(entry: Column) -> Column:
        org, held = entry["key"], entry["value"]
        fields = F.transform(F.map_entries(F.coalesce(held["fields"], F.create_map().cast("map<string, variant>"))), lambda f: unboxed(event("1", F.concat_ws(":", f["key"], org), f["value"])))
        members = F.transform(
            F.map_entries(F.coalesce(held["collections"], F.create_map().cast("map<string, array<variant>>"))),
            lambda c: F.transform(c["value"], lambda v: unboxed(event("2", F.concat_ws(":", c["key"], org), v))),
        )
        return F.concat(fields, F.flatten(members))

    events = F.flatten(F.transform(F.map_entries("sources"), of_source))
    return s.select(F.lit(0).cast("bigint").alias("id"), F.lit("snapshot").alias("tag"), "entity", events.alias("events"), F.col("at").alias("created_at"), F.lit(None).cast("bigint").alias("created_by"))


def _kind(field: Column, identity: tuple[str, ...]) -> Column:
    return F.when(field.isin(*identity), "identity").when(field.isin(*MEDIA_FIELDS), "media").when(field.rlike(EDGE_FIELDS), "edge").otherwise("attribute")


def decode(deltas: DataFrame, identity: tuple[str, ...] = IDENTITY_FIELDS) -> DataFrame:
    """The kept events of raw deltas, a row each, no shuffle; ordered in an entity by (recorded_at, delta, at).

    A key is ``field[:locale][:org]``; a delete names its source in the value; a code loses the prefix ``<field>_``; bookkeeping
    fields and recomputations go.
    """
    at = deltas.select("entity", F.col("id").alias("delta"), F.col("created_at").alias("recorded_at"), F.col("created_by").alias("by"), "tag", F.posexplode("events").alias("at", "e"))
    text = lambda i: F.variant_get(F.get("e", F.lit(i)), "$", "string")
    raw = at.select("entity", "delta", "recorded_at", "by", "tag", "at", text(0).alias("opcode"), F.split(text(1), ":").alias("parts"), F.get("e", F.lit(2)).alias("v"), text(2).alias("said"))
    rest = F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))
    field = F.get("parts", F.lit(0))
    named = raw.withColumn("field", field).where(~F.col("opcode").eqNullSafe(F.lit(DROPPED_OPCODE)) & ~F.coalesce(F.col("field").isin(*DROPPED_FIELDS), F.lit(False)))
    op = F.coalesce(*[F.when(F.col("opcode") == k, v) for k, v in OPS.items()], F.col("opcode"))
    last = lambda shape: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(rest, lambda x: x.rlike(shape))), -1)
    known = named.select(
        "entity", "delta", "at", "recorded_at", "by", "tag", op.alias("op"), _kind(F.col("field"), identity).alias("kind"), "field",
        last("^[A-Za-z]+$").alias("locale"), last("^[0-9]+$").alias("org"), "v", "said",
    )
    deleted, kind = F.col("op") == "delete", F.col("kind")
    source = F.when(deleted, F.coalesce("said", "org")).otherwise(F.col("org"))
    prefix = F.concat(F.col("field"), F.lit("_"))
    code = F.when(F.startswith("said", prefix), F.expr("substring(said, length(field) + 2)")).otherwise(F.col("said"))
    value = F.when(~deleted, tagged(F.col("v")))
    return known.select(
        "entity", "delta", "at", "recorded_at", "by", "tag", "op", "kind", source.alias("source"),
        F.when(kind == "identity", F.col("field")).alias("scheme"),
        F.when((kind == "identity") & ~deleted, code).alias("code"),
        F.when(kind == "attribute", F.col("field")).alias("field"),
        F.when(kind == "attribute", F.col("locale")).alias("locale"),
        F.when(kind.isin("edge", "media"), F.col("field")).alias("collection"),
        F.when(kind != "identity", value).alias("value"),
    )


def touched(deltas: DataFrame) -> DataFrame:
    """entity, last_touched_at, dropped_meta_count: when each entity was last touched, bookkeeping deltas included, and how many deltas
    hold nothing else. Aggregated in each task before the shuffle."""
    name = lambda e: F.get(F.split(F.variant_get(F.get(e, F.lit(1)), "$", "string"), ":"), F.lit(0))
    opcode = lambda e: F.variant_get(F.get(e, F.lit(0)), "$", "string")
    kept = F.filter("events", lambda e: ~opcode(e).eqNullSafe(F.lit(DROPPED_OPCODE)) & ~F.coalesce(name(e).isin(*DROPPED_FIELDS), F.lit(False)))
    stamps = F.transform(
        F.filter("events", lambda e: ~opcode(e).eqNullSafe(F.lit(DROPPED_OPCODE)) & (name(e) == "updatedAt") & (F.schema_of_variant(F.get(e, F.lit(2))) == "BIGINT")),
        lambda e: F.variant_get(F.get(e, F.lit(2)), "$", "bigint"),
    )
    own = deltas.select("entity", F.greatest(F.col("created_at"), F.array_max(stamps)).alias("at"), (F.size(F.coalesce(kept, F.array().cast("array<array<variant>>"))) == 0).alias("empty"))
    return own.groupBy("entity").agg(F.max("at").alias("last_touched_at"), F.count_if("empty").alias("dropped_meta_count"))


def with_own_identity(events: DataFrame, scheme: str, source: str) -> DataFrame:
    """Prepend an identity of the entity's own id, for entities whose histories hold no code (texts, assets, leaflets)."""
    first = events.groupBy("entity").agg(F.min("recorded_at").alias("recorded_at"))
    made = {"delta": F.lit(-1).cast("bigint"), "at": F.lit(-1), "op": F.lit("set"), "kind": F.lit("identity"), "source": F.lit(source), "scheme": F.lit(scheme), "code": F.col("entity").cast("string")}
    return events.unionByName(first.select("entity", "recorded_at", *[c.alias(n) for n, c in made.items()]), allowMissingColumns=True)


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files, one history each."""
    return envelopes_of(spark.read.text(path, wholetext=True).select(F.col("value").alias("line")))


# The JSON type that each part of a history and of an event has, if it is not null.
WHOLE_TYPES = {"source_system": "STRING", "last_touched_at": "BIGINT", "dropped_meta_count": "BIGINT"}
EVENT_TYPES = {"recorded_at": "BIGINT", "valid_from": "BIGINT", "by": "BIGINT", "tag": "STRING", "source": "STRING", "scheme": "STRING", "code": "STRING", "field": "STRING", "locale": "STRING", "collection": "STRING"}


def _misfit(value: Column, types: dict[str, str]) -> Column:
    """The first name whose part of a variant object has another type than it should, or null. Numbers that look like text are not text."""
    wrong = []
    for name, kind in types.items():
        part = F.try_variant_get(value, f"$.{name}", "variant")
        wrong.append(F.when(~F.schema_of_variant(part).isin(kind, "VOID"), F.lit(name)))
    return F.coalesce(*wrong)


def envelopes_of(lines: DataFrame) -> DataFrame:
    """Histories from a column ``line``, with ``raw`` (the events as JSON), ``bad_type`` and ``bad_types`` (the misfits of the whole and of
    each event, or null)."""
    v = F.try_parse_json("line")
    events = F.try_variant_get(v, "$.events", "array<variant>")
    return lines.select(
        F.from_json("line", ENVELOPE).alias("d"), F.get_json_object("line", "$.events").alias("raw"), _misfit(v, WHOLE_TYPES).alias("bad_type"), F.transform(events, lambda e: _misfit(e, EVENT_TYPES)).alias("bad_types")
    ).select("d.*", "raw", "bad_type", "bad_types")


def envelope_events(envelopes: DataFrame) -> DataFrame:
    """The events of histories, in order, each with ``error``: why its history is to be refused, or null. valid_from falls back to
    recorded_at. A history of another version, without a list of events, or with parts of another type, gives one row with an error."""
    bad = F.when(~F.col("schema_version").eqNullSafe(F.lit(VERSION)), "unsupported_version").when(F.col("raw").isNull(), "missing_events").when(~F.startswith("raw", F.lit("[")), "events_not_a_list").when(F.col("bad_type").isNotNull(), F.concat(F.lit("bad_type "), "bad_type")).when(F.col("events").isNull(), "event_not_an_object")
    rows = envelopes.withColumn("bad", bad).select("legacy_entity", "source_system", "bad", "bad_types", F.posexplode_outer(F.when(F.col("bad").isNull(), F.col("events"))).alias("order", "e"))
    rows = rows.where(F.col("bad").isNotNull() | F.col("order").isNotNull())
    deleted, e = F.col("e.op") == "delete", lambda n: F.col(f"e.{n}")
    error = (
        F.when(F.col("bad").isNotNull(), F.col("bad"))
        .when(F.get("bad_types", F.col("order")).isNotNull(), F.concat(F.lit("bad_type "), F.get("bad_types", F.col("order"))))
        .when(e("recorded_at").isNull(), "missing_recorded_at")
        .when(~F.coalesce(e("op").isin(*OPS.values()), F.lit(False)), "unknown_op")
        .when(~F.coalesce(e("kind").isin(*KINDS), F.lit(False)), "unknown_kind")
        .when((e("kind") == "identity") & e("scheme").isNull(), "missing_scheme")
        .when((e("kind") == "identity") & (F.length(e("code")) > MAX_CODE), "code_too_long")
        .when((e("kind") == "attribute") & e("field").isNull(), "missing_field")
        .when((e("kind") == "attribute") & ~deleted & e("value").isNull(), "missing_value")
        .when((e("kind") == "edge") & (e("collection").isNull() | (~deleted & e("value").isNull())), "missing_member")
        .when((e("kind") == "media") & ~deleted & e("asset").isNull(), "missing_asset")
    )
    return rows.select(
        F.col("legacy_entity").alias("entity"), "source_system", "order", e("recorded_at"), F.coalesce(e("valid_from"), e("recorded_at")).alias("valid_from"),
        e("by"), e("tag"), e("source"), e("op"), e("kind"), e("scheme"), e("code"), e("field"), e("locale"), e("collection"),
        tagged(F.coalesce(e("value"), e("asset"))).alias("value"), error.alias("error"),
    )


def accepted(events: DataFrame) -> DataFrame:
    """Events of the histories that hold no error: a history is taken whole or not at all."""
    refused = events.where("error IS NOT NULL").select(F.col("entity").alias("refused")).distinct()
    return events.join(refused, events["entity"].eqNullSafe(refused["refused"]), "left_anti").drop("error")


def kind_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def encoded(value: Column) -> Column:
    """STRUCT(t, s) as the JSON that tagged() reads: whatever the type, decoding gives the value again."""
    quoted = F.regexp_replace(F.to_json(F.array(value["s"])), r"^\[|\]$", "")
    return F.when(value["t"] == "s", quoted).when(value["t"] == "n", "null").otherwise(value["s"])


def decoded(text: Column) -> Column:
    """STRUCT(t, s) of a JSON text; null if it is none."""
    return tagged(F.try_parse_json(text))
