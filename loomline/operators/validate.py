"""Findings over a batch of claims: errors refuse the whole batch, warnings do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import codes

# Fixed values.
KINDS = ("identity", "attribute", "media", "grouping", "edge")
ROLES = ("primary", "secondary")
KNOWN = (*codes.GTIN_FAMILY, *codes.NATIONAL, *codes.BARCODE, *codes.NEVER_BRIDGES, *codes.LANES, "uuid", "product_id")


def _finding(when: Column, field: str, level: str, finding: str) -> Column:
    said = F.struct(F.lit(field).alias("field"), F.lit(level).alias("level"), F.lit(finding).alias("finding"))
    return F.when(F.coalesce(when, F.lit(False)), F.array(said)).otherwise(F.array().cast("array<struct<field: string, level: string, finding: string>>"))


def of_code(code: Column, field: str, applies: Column) -> list[Column]:
    """What there is to say of a 'scheme:value' code where ``applies``."""
    parsed = codes.parse(code)
    scheme, fixed = parsed["scheme"], codes.canonical(parsed["scheme"], parsed["value"])
    family = applies & scheme.isin(*codes.GTIN_FAMILY)
    shaped = (fixed["scheme"] == "gtin") & fixed["value"].rlike("^[0-9]{14}$")
    return [
        _finding(applies & code.isNull(), field, "error", "required"),
        _finding(applies & code.isNotNull() & parsed.isNull(), field, "error", "not scheme:value"),
        _finding(family & shaped & ~codes.valid_gtin(fixed), field, "warning", "gtin check digit"),
        _finding(family & shaped & codes.restricted(fixed), field, "warning", "restricted gtin"),
        _finding(family & ~shaped, field, "warning", "not gtin-shaped"),
        _finding(applies & (scheme == "cnk") & ~codes.cnk_valid(parsed["value"]), field, "warning", "cnk check digit"),
        _finding(applies & parsed.isNotNull() & ~scheme.isin(*KNOWN), field, "warning", "unknown scheme"),
    ]


def findings(claims: DataFrame) -> DataFrame:
    """index, field, level, finding. From claims(index, source, kind, code, to, relation, field, role, valid_from, valid_to), dates as
    text; nulls stand for absent parts. Column expressions only: a scan without a shuffle."""
    c, kind = F.col, F.col("kind")
    from_date, to_date = F.try_to_date(c("valid_from")), F.try_to_date(c("valid_to"))
    lanes = [codes.lane(codes.parse(c(x))["scheme"]) for x in ("code", "to")]
    edge = kind == "edge"
    listed = [
        _finding(c("source").isNull() | (c("source") == ""), "source", "error", "required"),
        _finding(kind.isNull() | ~kind.isin(*KINDS), "kind", "error", "unknown kind"),
        *of_code(c("code"), "code", kind.isin(*KINDS)),
        *of_code(c("to"), "to", edge),
        _finding((kind == "attribute") & c("field").isNull(), "field", "error", "required"),
        _finding(edge & ~F.coalesce(c("relation").isin(*codes.RELATIONS), F.lit(False)), "relation", "error", "unknown relation"),
        _finding(edge & c("relation").isin(*codes.RELATIONS) & ~codes.signature_ok(c("relation"), codes.parse(c("code"))["scheme"], codes.parse(c("to"))["scheme"]), "relation", "error", "lanes do not fit"),
        _finding((kind == "media") & ~c("role").isin(*ROLES), "role", "warning", "taken as secondary"),
        _finding(c("valid_from").isNotNull() & from_date.isNull(), "valid_from", "error", "no date"),
        _finding(c("valid_to").isNotNull() & to_date.isNull(), "valid_to", "error", "no date"),
        _finding(from_date >= to_date, "valid_to", "error", "not later than valid_from"),
        _finding((kind == "identity") & (lanes[0] != lanes[1]), "code", "error", "mixed lanes"),
    ]
    return claims.select("index", F.explode(F.flatten(F.array(*listed))).alias("f")).select("index", "f.*")
