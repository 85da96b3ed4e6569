"""Code kernels: pure column functions over a scheme and a value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
GTIN_FAMILY = ("gtin", "ean", "upc")
PADDED = {"cip_acl7": 7, "pzn": 8, "pzn_austria": 7, "sukl": 7, "cefip": 7, "national_code": 7, "cn": 6}
NATIONAL = ("cnk", "cip_acl7", "cefip", "pzn", "pzn_austria", "sukl", "national_code", "cn", "pdk", "ndc", "hri", "pin", "lppr", "fred", "zcode", "isbn13", "isbn10")
BARCODE = ("gtin", "acl13", "cip13")
NEVER_BRIDGES = ("mpn", "supplier_ref", "artg_id")
LANES = {"cas": "substance", "unii": "substance", "substance_id": "substance", "text_id": "description", "asset_id": "media", "leaflet_id": "media"}
KEY_PREFIX = {"product": "SK", "substance": "SUB", "description": "DSC", "media": "MED"}
RELATIONS = {"contains": (["product"], ["substance"]), "describes": (["description"], ["product", "substance"]), "depicts": (["media"], ["product", "substance"]), "member_of": (["product"], None), "suppress": (["description"], ["product"])}
UNITS = {"weight": {"g": 1, "kg": 1000}, "width": {"mm": 1, "cm": 10}, "depth": {"mm": 1, "cm": 10}, "length": {"mm": 1, "cm": 10}}


def let(value: Column, body) -> Column:
    """body(value) with value computed once: the optimizer would write it out wherever body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(value: Column) -> Column:
    """Without white space of any kind at either end (Spark's trim takes spaces only)."""
    return F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _digits(value: Column) -> Column:
    return value.rlike("^[0-9]+$")


def canonical(scheme: Column, value: Column) -> Column:
    """STRUCT(scheme, value): the GTIN family as GTIN-14, short national codes padded, anything else trimmed."""
    v = trim(value)
    gtin = scheme.isin(*GTIN_FAMILY) & _digits(v) & F.length(v).isin(8, 12, 13, 14)
    padded = reduce(lambda rest, x: F.when((scheme == x[0]) & _digits(v) & (F.length(v) < x[1]), F.lpad(v, x[1], "0")).otherwise(rest), PADDED.items(), v)
    return F.struct(F.when(gtin, F.lit("gtin")).otherwise(scheme).alias("scheme"), F.when(gtin, F.lpad(v, 14, "0")).otherwise(padded).alias("value"))


def same(scheme: Column, value: Column, other_scheme: Column, other_value: Column) -> Column:
    """Whether two codes are one, however they are written."""
    return canonical(scheme, value) == canonical(other_scheme, other_value)


def _digit(value: Column, at: Column) -> Column:
    return F.substring(value, at, F.lit(1)).cast("int")


def weighted_sum(value: Column, n: int, weight) -> Column:
    """Sum over the first n digits; weight(digit, place from 1)."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, i: a + weight(_digit(value, i), i))


def check_digit(gtin14: Column) -> Column:
    """GS1 modulo 10 over the first 13 digits."""
    return (10 - weighted_sum(gtin14, 13, lambda d, i: d * F.when(i % 2 == 1, 3).otherwise(1)) % 10) % 10


def valid_gtin(code: Column) -> Column:
    ok = (code["scheme"] == "gtin") & code["value"].rlike("^[0-9]{14}$")
    return F.when(ok, check_digit(code["value"]) == F.substring(code["value"], 14, 1).cast("int")).otherwise(F.lit(False))


def indicator(code: Column) -> Column:
    return F.when((code["scheme"] == "gtin") & code["value"].rlike("^[0-9]{14}$"), F.substring(code["value"], 1, 1).cast("int"))


def restricted(code: Column) -> Column:
    two = F.substring(code["value"], 2, 2)
    return (code["scheme"] == "gtin") & code["value"].rlike("^[0-9]{14}$") & ((two == "02") | two.between("20", "29"))


def bridge_grade(scheme: Column) -> Column:
    return F.when(scheme.isin(*NATIONAL), "national").when(scheme.isin(*BARCODE), "barcode").otherwise("none")


def never_bridges(code: Column) -> Column:
    return restricted(code) | code["scheme"].isin(*NEVER_BRIDGES)


def lane(scheme: Column) -> Column:
    """Null for uuid, which belongs to any lane."""
    listed = F.coalesce(*[F.when(scheme == k, F.lit(v)) for k, v in LANES.items()], F.lit("product"))
    return F.when(scheme != "uuid", listed)


def key_lane(key: Column) -> Column:
    prefix = F.regexp_extract(key, "^(.*)_[0-9]+$", 1)
    return F.coalesce(*[F.when(prefix == p, F.lit(x)) for x, p in KEY_PREFIX.items()])


def signature_ok(relation: Column, from_scheme: Column, to_scheme: Column) -> Column:
    def side(scheme: Column, lanes: list[str] | None) -> Column:
        return F.lit(True) if lanes is None else lane(scheme).isNull() | lane(scheme).isin(*lanes)

    return F.coalesce(*[F.when(relation == r, side(from_scheme, a) & side(to_scheme, b)) for r, (a, b) in RELATIONS.items()], F.lit(False))


def cnk_valid(value: Column) -> Column:
    """Of seven digits: the last is the modulo-10 check digit, every second digit doubled from the sixth on. Null otherwise."""
    total = weighted_sum(value, 6, lambda d, i: F.when(i % 2 == 0, F.floor(d * 2 / 10) + d * 2 % 10).otherwise(d).cast("int"))
    return F.when(value.rlike("^[0-9]{7}$"), (10 - total % 10) % 10 == F.substring(value, 7, 1).cast("int"))


def isbn13(raw: Column) -> Column:
    """The 13-digit form of a valid ISBN-10 or ISBN-13 (hyphens and spaces aside); null otherwise."""
    v = F.upper(F.regexp_replace(raw, "[- ]", ""))
    ten = weighted_sum(v, 9, lambda d, i: d * (11 - i)) + F.when(F.substring(v, 10, 1) == "X", 10).otherwise(F.expr("0"))
    last = F.when(F.substring(v, 10, 1) == "X", 0).otherwise(F.substring(v, 10, 1).try_cast("int"))
    body = F.concat(F.lit("978"), F.substring(v, 1, 9))
    ean = lambda x: (10 - weighted_sum(x, 12, lambda d, i: d * F.when(i % 2 == 0, 3).otherwise(1)) % 10) % 10
    from_ten = F.when((ten + last) % 11 == 0, F.concat(body, ean(body).cast("string")))
    as_is = F.when(ean(v) == F.substring(v, 13, 1).try_cast("int"), v)
    return F.when(v.rlike("^[0-9]{9}[0-9X]$"), from_ten).when(v.rlike("^97[89][0-9]{10}$"), as_is)


def quantity(field: Column, value: Column) -> Column:
    """'<number>_<unit>' of a declared field in its base unit, as a string; a whole number where it is one, other values as they are."""
    factors = {f"{f}_{u}": float(k) for f, us in UNITS.items() for u, k in us.items()}
    table = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    factor = F.try_element_at(table, F.concat_ws("_", field, F.regexp_extract(value, r"^[0-9]+(?:\.[0-9]+)?_([a-z]+)$", 1)))
    scaled = F.regexp_extract(value, r"^([0-9]+(?:\.[0-9]+)?)_", 1).try_cast("double") * factor

    def told(x: Column) -> Column:
        whole = F.abs(x - F.round(x)) < 1e-9
        return F.when(x.isNull(), value).when(whole, F.round(x).cast("bigint").cast("string")).otherwise(x.cast("string"))

    return let(scaled, told)


def parse(code: Column) -> Column:
    """'scheme:value' split at the first colon; null unless both halves have text."""
    parts = F.split(code, ":", 2)
    return F.when((F.size(parts) == 2) & (parts[0] != "") & (parts[1] != ""), F.struct(parts[0].alias("scheme"), parts[1].alias("value")))
