"""Names and values of dimensions: field names, aliases, lists of one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field_name(field: Column, locale: Column) -> Column:
    """``field[:locale]``."""
    return F.concat_ws(":", field, locale)


def terminal(aliases: dict[str, str]) -> dict[str, str]:
    """Where each alias ends. A cycle is left after as many hops as there are aliases."""
    found = {}
    for name in aliases:
        at = name
        for _ in aliases:
            if at not in aliases:
                break
            at = aliases[at]
        found[name] = at
    return found


def resolve(name: Column, aliases: dict[str, str]) -> Column:
    """The name that ``name`` goes by now: an alias of the whole name comes first, then one of its field, the locale kept. Aliases are
    configuration, a literal map in the plan."""
    if not aliases:
        return name
    ends = F.create_map(*[F.lit(x) for pair in terminal(aliases).items() for x in pair])
    parts = F.split(name, ":", 2)
    by_field = F.when(F.size(parts) == 2, F.concat_ws(":", F.coalesce(F.try_element_at(ends, parts[0]), parts[0]), F.get(parts, F.lit(1)))).otherwise(name)
    whole = F.try_element_at(ends, name)
    return F.when(whole.isNotNull() & (whole != name), whole).otherwise(by_field)


def unwrapped(value: Column) -> Column:
    """A JSON list of one value as that value's JSON; anything else as it is."""
    items = F.from_json(value, "array<variant>")
    one = F.startswith(F.trim(value), F.lit("[")) & (F.size(items) == 1)
    return F.when(one, F.to_json(F.get(items, F.lit(0)))).otherwise(value)
