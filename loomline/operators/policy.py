"""A scoring policy for survivorship: ranks from scores by field, organisation group and organisation, with a band below for outsiders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators import catalog

#: A rank is minus the score times OFFSET plus the source's place among sources of that score; unlisted sources come last.
OFFSET = 1_000_000
UNLISTED = OFFSET - 1


@dataclass(frozen=True)
class Context:
    """What the policy goes by. It is configuration, as large as the list of organisations, and a literal in the plan.

    field_scores: field -> {group or organisation: score}; group_of: organisation -> group; product_orgs and delta_orgs: organisations of
    the product, and those about to join it; labo_orgs: counted among them in the region ``be`` only; system_sources: never outsiders;
    source_order: places among equal scores; penalty: whether outsiders are scored -1.
    """

    field_scores: dict[str, dict[str, int]] = field(default_factory=dict)
    group_of: dict[str, str] = field(default_factory=dict)
    product_orgs: tuple[str, ...] = ()
    labo_orgs: tuple[str, ...] = ()
    delta_orgs: tuple[str, ...] = ()
    system_sources: tuple[str, ...] = ()
    source_order: tuple[str, ...] = ()
    region: str = "be"
    penalty: bool = True

    @property
    def insiders(self) -> tuple[str, ...]:
        labo = self.labo_orgs if self.region == "be" else ()
        return tuple(dict.fromkeys((*self.product_orgs, *labo, *self.delta_orgs, *self.system_sources)))


def _map(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key) if table else F.lit(None)


def rank_of(context: Context) -> Callable[[Column, Column], Column]:
    """A policy for catalog.with_rank(): a source's score is its group's in the field, else its own, else 0; outsiders score -1."""
    flat = {f"{f}\x1f{s}": n for f, own in context.field_scores.items() for s, n in own.items()}
    places = {s: k for k, s in reversed(list(enumerate(context.source_order)))}

    def rank(dimension: Column, source: Column) -> Column:
        source = source.cast("string")
        of = lambda name: _map(flat, F.concat(dimension, F.lit("\x1f"), name)).cast("bigint")
        group = _map(context.group_of, source).cast("string")
        score = F.coalesce(of(group), of(source), F.lit(0).cast("bigint"))
        if context.penalty:
            inside = source.isin(*context.insiders) if context.insiders else F.lit(False)
            score = F.when(F.coalesce(inside, F.lit(False)), score).otherwise(F.lit(-1).cast("bigint"))
        return -score * OFFSET + F.coalesce(_map(places, source).cast("bigint"), F.lit(UNLISTED).cast("bigint"))

    return rank


def penalty_flips(members: DataFrame, live: DataFrame, context: Context) -> DataFrame:
    """lane, key, field and the value, winner and status with and without the penalty, where they differ."""
    told = lambda on: catalog.attributes(members, live, rank_of(replace(context, penalty=on))).select("lane", "key", "field", F.struct("value", "winner", "status").alias("with" if on else "without"))
    return told(True).join(told(False), ["lane", "key", "field"]).where(~F.col("with").eqNullSafe(F.col("without")))
