"""Code schemes: the built-in registry of source fields, and registries read from a document at run time."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import codes

# Source field -> (scheme, class).
FIELDS = {
    "cnk": ("cnk", "identity"),
    "cipOrAcl7": ("cip_acl7", "identity"),
    "acl13": ("acl13", "identity"),
    "cip13": ("cip13", "identity"),
    "pzn": ("pzn", "identity"),
    "pznAustria": ("pzn_austria", "identity"),
    "sukl": ("sukl", "identity"),
    "pdk": ("pdk", "identity"),
    "cn": ("cn", "identity"),
    "cefip": ("cefip", "identity"),
    "nationalCode": ("national_code", "identity"),
    "ndc": ("ndc", "identity"),
    "hri": ("hri", "identity"),
    "pin": ("pin", "identity"),
    "fred": ("fred", "identity"),
    "zcode": ("zcode", "identity"),
    "lppr": ("lppr", "identity"),
    "ean": ("gtin", "identity"),
    "gtin": ("gtin", "identity"),
    "eanGtin8": ("gtin", "identity"),
    "eanGtin12": ("gtin", "identity"),
    "eanGtin13": ("gtin", "identity"),
    "eanGtin14": ("gtin", "identity"),
    "undefinedEanGtinCode": ("gtin", "identity"),
    "usaGtinCode": ("gtin", "identity"),
    "upc10": ("gtin", "identity"),
    "upc11": ("gtin", "identity"),
    "upc12": ("gtin", "identity"),
    "cbId": ("cb_id", "external_ref"),
    "ospId": ("osp_id", "external_ref"),
    "offisanteId": ("offisante_id", "external_ref"),
    "cisCode": ("cis_code", "external_ref"),
    "publicPageIdentifier": ("public_page_identifier", "external_ref"),
    "artgId": ("artg_id", "identity"),
    "snomedCtpp": ("snomed_ctpp", "external_ref"),
    "snomedTpp": ("snomed_tpp", "external_ref"),
    "snomedMpp": ("snomed_mpp", "external_ref"),
    "snomedTp": ("snomed_tp", "external_ref"),
    "snomedMp": ("snomed_mp", "external_ref"),
    "snomedTpuu": ("snomed_tpuu", "external_ref"),
    "snomedMpuu": ("snomed_mpuu", "external_ref"),
    "supplierReference": ("supplier_ref", "external_ref"),
    "replacement": ("replacement_id", "external_ref"),
    "isbn13": ("isbn13", "identity"),
    "isbn10": ("isbn10", "identity"),
    "productId": ("product_id", "entity_id"),
    "hsCode": ("hs_code", "attribute"),
    "pbs": ("pbs", "attribute"),
}
# Schemes that no field names -> (canonical scheme, class).
SCHEMES = {
    "mpn": ("mpn", "external_ref"),
    "supplier_ref": ("supplier_ref", "external_ref"),
    "ean": ("gtin", "identity"),
    "upc": ("gtin", "identity"),
    "cas": ("cas", "identity"),
    "unii": ("unii", "identity"),
    "substance_id": ("substance_id", "identity"),
    "text_id": ("text_id", "identity"),
    "asset_id": ("asset_id", "identity"),
    "leaflet_id": ("leaflet_id", "identity"),
    "uuid": ("uuid", "identity"),
}
# The vocabulary of a registry document.
CLASSES = ("identity", "external_ref", "attribute", "entity_id")
ENTITY_TYPES = ("product", "substance", "description", "media")
GRADES = ("national", "barcode", "none")
CHECKSUMS = ("none", "gtin_mod10", "mod-11")
VERSION = "1"

#: Fields whose values identify, and every scheme that the engine knows by name. Those sort before others.
IDENTITY_FIELDS = tuple(f for f, (_, c) in FIELDS.items() if c == "identity")
KNOWN = tuple(sorted({s for s, _ in FIELDS.values()} | set(SCHEMES)))

_NAME = re.compile(r"[a-z][a-z0-9_]*")


def _lookup(table: dict, key: Column, otherwise: Column) -> Column:
    """A literal map in the plan: configuration, bounded by its document."""
    if not table:
        return otherwise
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), otherwise)


def scheme(name: Column) -> Column:
    """The scheme of a source field; an unknown field is a scheme of its own."""
    return _lookup({f: s for f, (s, _) in FIELDS.items()}, name, name)


def classification(name: Column) -> Column:
    """What a source field is for; an unknown one is an attribute."""
    return _lookup({f: c for f, (_, c) in FIELDS.items()}, name, F.lit("attribute"))


def known_scheme(name: Column) -> Column:
    return F.coalesce(name.isin(*KNOWN), F.lit(False))


def code_of(scheme_name: Column, value: Column) -> Column:
    """``scheme:value`` in canonical form; null if either is."""
    c = codes.canonical(scheme_name, value)
    return F.when(scheme_name.isNotNull() & value.isNotNull(), F.concat_ws(":", c["scheme"], c["value"]))


def scheme_of(code: Column) -> Column:
    return F.get(F.split(code, ":", 2), F.lit(0))


def value_of(code: Column) -> Column:
    return F.get(F.split(code, ":", 2), F.lit(1))


def parts(code: Column) -> Column:
    return F.struct(scheme_of(code).alias("scheme"), value_of(code).alias("value"))


def code_order(code: Column) -> Column:
    """Sorts known schemes before others, then by scheme and value."""
    return F.struct((~known_scheme(scheme_of(code))).alias("unknown"), code.alias("code"))


def sorted_codes(array: Column) -> Column:
    return F.transform(F.array_sort(F.transform(array, code_order)), lambda x: x["code"])


def lane_of_codes(array: Column, entity: Column) -> Column:
    """The one lane of an identity's codes; the entity it names, or product, where its codes belong to any lane; null where they mix lanes."""
    lanes = F.array_distinct(F.filter(F.transform(array, lambda c: codes.lane(scheme_of(c))), lambda x: x.isNotNull()))
    return F.when(F.size(lanes) == 0, F.coalesce(entity, F.lit("product"))).when(F.size(lanes) == 1, F.get(lanes, F.lit(0)))


@dataclass(frozen=True)
class Registry:
    """Schemes and relations that a document declares; what it does not declare keeps its built-in meaning."""

    schemes: dict[str, dict] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    relations: dict[str, dict] = field(default_factory=dict)

    def canonical_name(self, name: Column) -> Column:
        """The declared name of a scheme or of its alias; null if undeclared."""
        return _lookup(self.aliases, name, F.lit(None).cast("string"))

    def rule(self, name: Column, what: str) -> Column:
        """``class``, ``lane``, ``bridge_grade``, ``normalizer``, ``checksum`` or ``equivalence_family`` of a scheme or alias, as text."""
        told = {n: r[what] for n, r in self.schemes.items() if r[what] is not None}
        return _lookup(told, self.canonical_name(name), F.lit(None).cast("string"))

    def lane(self, name: Column) -> Column:
        """A declared scheme's lane, or the built-in one; null for uuid."""
        return F.when(name != "uuid", F.coalesce(self.rule(name, "lane"), codes.lane(name)))

    def canonical(self, name: Column, value: Column) -> Column:
        """STRUCT(scheme, value) by the declared names and normalizers; undeclared schemes by the built-in forms."""
        declared, how, v = self.canonical_name(name), self.rule(name, "normalizer"), codes.trim(value)
        digits = v.rlike("^[0-9]+$")
        width = F.regexp_extract(how, "^pad_left:([0-9]+)$", 1).try_cast("int")
        padded = F.when(digits & (F.length(v) < width), F.lpad(v, width, F.lit("0"))).otherwise(v)
        gtin = F.when(digits & F.length(v).isin(8, 12, 13, 14), F.lpad(v, 14, "0")).otherwise(v)
        own = F.struct(declared.alias("scheme"), F.when(how == "gtin", gtin).when(width.isNotNull(), padded).otherwise(v).alias("value"))
        return F.when(declared.isNotNull(), own).otherwise(codes.canonical(name, value))

    def signature_ok(self, relation: Column, from_scheme: Column, to_scheme: Column) -> Column:
        """Whether an edge's lanes fit its relation: a declared one, or else a built-in one."""
        fits = lambda lane, lanes: F.lit(True) if lanes is None else lane.isNull() | lane.isin(*lanes)
        told = [F.when(relation == n, fits(self.lane(from_scheme), r["from"]) & fits(self.lane(to_scheme), r["to"])) for n, r in self.relations.items()]
        return F.coalesce(*told, codes.signature_ok(relation, from_scheme, to_scheme))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, r["class"], r["lane"], r["bridge_grade"], r["normalizer"], r["checksum"], r["equivalence_family"], sorted(a for a, o in self.aliases.items() if o == n and a != n)) for n, r in self.schemes.items()]
        return spark.createDataFrame(rows, "name string, class string, lane string, bridge_grade string, normalizer string, checksum string, equivalence_family string, aliases array<string>")


class Invalid(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


def _named(value: object, where: str) -> list[str]:
    if not isinstance(value, str):
        return [f"{where} must be a string, got {value!r}"]
    return [] if _NAME.fullmatch(value) else [f"{where} must be lowercase snake_case, got {value!r}"]


def _one_of(value: object, allowed: tuple, where: str) -> list[str]:
    return [] if value in allowed else [f"{where} has unknown value {value!r}"]


def _normalizer(said: object) -> str | None:
    if not isinstance(said, dict):
        return None
    kind, width = said.get("kind"), said.get("width")
    if kind in ("trim", "gtin"):
        return kind
    return f"pad_left:{width}" if kind == "pad_left" and type(width) is int and width > 0 else None


def _scheme(raw: object, at: int) -> tuple[dict | None, list[str]]:
    if not isinstance(raw, dict) or "name" not in raw or "class" not in raw:
        return None, [f"scheme[{at}] must be an object with name and class, got {raw!r}"]
    name, aliases, of = raw["name"], raw.get("aliases", []), f"scheme {raw['name']!r}"
    normalizer, family = _normalizer(raw.get("normalizer", {"kind": "trim"})), raw.get("equivalence_family")
    errors = _named(name, f"scheme[{at}].name")
    for key, allowed, default in (("class", CLASSES, None), ("entity_type", ENTITY_TYPES, "product"), ("bridge_grade", GRADES, "none"), ("checksum", CHECKSUMS, "none")):
        errors += _one_of(raw.get(key, default), allowed, f"{of} {key}")
    errors += [e for a in aliases for e in _named(a, f"{of} alias")] if isinstance(aliases, list) else [f"{of} aliases must be an array, got {aliases!r}"]
    errors += _named(family, f"{of} equivalence_family") if family is not None else []
    errors += [f"{of} has invalid normalizer {raw['normalizer']!r}"] if normalizer is None else []
    rule = {"class": raw["class"], "lane": raw.get("entity_type", "product"), "bridge_grade": raw.get("bridge_grade", "none"), "normalizer": normalizer, "checksum": raw.get("checksum", "none"), "equivalence_family": family}
    return ({"name": name, "aliases": aliases, "rule": rule} if not errors else None), errors


def _relation(raw: object, at: int) -> tuple[dict | None, list[str]]:
    if not isinstance(raw, dict) or not {"name", "from", "to"} <= set(raw):
        return None, [f"relation[{at}] must contain name, from, and to, got {raw!r}"]
    errors = _named(raw["name"], f"relation[{at}].name")
    for side in ("from", "to"):
        lanes = raw[side]
        if side == "to" and lanes is None:
            continue
        if not isinstance(lanes, list) or not lanes:
            errors.append(f"relation {raw['name']!r} {side} must be a non-empty lane array, got {lanes!r}")
        else:
            errors += [f"relation {raw['name']!r} {side} contains unknown lane {x!r}" for x in lanes if x not in ENTITY_TYPES]
    return (raw if not errors else None), errors


def registry(document: object) -> Registry:
    """A registry from a decoded document. All that is wrong with it is raised at once."""
    if not isinstance(document, dict) or "schema_version" not in document:
        raise Invalid(['registry must contain schema_version "1" and a schemes array'])
    if document["schema_version"] != VERSION:
        raise Invalid([f"unsupported schema_version {document['schema_version']!r}"])
    if not isinstance(document.get("schemes"), list):
        raise Invalid(['registry must contain schema_version "1" and a schemes array'])
    relations = document.get("relations", [])
    errors = [] if isinstance(relations, list) else [f"relations must be an array, got {relations!r}"]
    found = [_scheme(x, k) for k, x in enumerate(document["schemes"])]
    edges = [_relation(x, k) for k, x in enumerate(relations if isinstance(relations, list) else [])]
    errors += [e for _, own in found + edges for e in own]
    owners: dict[str, list[str]] = {}
    for s, _ in found:
        for spelling in [s["name"], *s["aliases"]] if s else []:
            owners.setdefault(spelling, []).append(s["name"])
    errors += [f"alias {a!r} is declared more than once by {sorted(own)!r}" for a, own in owners.items() if len(own) > 1]
    names = [r["name"] for r, _ in edges if r]
    errors += [f"relation {n!r} is declared more than once" for n in dict.fromkeys(names) if names.count(n) > 1]
    if errors:
        raise Invalid(errors)
    return Registry({s["name"]: s["rule"] for s, _ in found}, {a: own[0] for a, own in owners.items()}, {r["name"]: {"from": r["from"], "to": r["to"]} for r, _ in edges})


def from_json(text: str) -> Registry:
    try:
        document = json.loads(text)
    except ValueError as e:
        raise Invalid([f"invalid registry JSON: {e}"]) from e
    return registry(document)


def metadata(spark: SparkSession) -> DataFrame:
    """wire_name, canonical_name, class, lane of every field and scheme that the engine knows."""
    rows = [(n, s, c) for n, (s, c) in FIELDS.items()] + [(n, s, c) for n, (s, c) in SCHEMES.items() if n not in FIELDS]
    return spark.createDataFrame(rows, "wire_name string, canonical_name string, class string").withColumn("lane", codes.lane(F.col("canonical_name")))
