"""Row predicates from a mapping of filters, and fields with a fallback to metadata.

`<field>_min` holds from the bound on, `<field>_max` below it, `<field>_in` for
members; a null field never passes.  A NaN passes the minima of SPECIAL alone.
Text that isn't a number under a numeric filter is an error.  Keys without these
endings are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

#: Fixed values.
CONTAINERS = ("metadata", "meta", "attributes")
ENGLISH = ("en", "eng", "english")
SPECIAL = ("edu_int_score_min", "language_score_min")


def field(df: DataFrame, name: str) -> Column:
    """A column, or else the field of that name in the first metadata container that has it."""
    if name in df.columns:
        return df[name]
    out = F.lit(None).cast("string")
    for c in reversed([c for c in CONTAINERS if c in df.columns]):
        kind = df.schema[c].dataType
        if isinstance(kind, T.StructType):
            if name in kind.fieldNames():
                out = F.when(df[c].isNotNull(), df[c][name].cast("string")).otherwise(out)
        elif isinstance(kind, T.MapType):
            out = F.when(F.coalesce(F.map_contains_key(df[c], name), F.lit(False)), df[c][name].cast("string")).otherwise(out)
        elif isinstance(kind, T.StringType):
            has = F.coalesce(F.array_contains(F.json_object_keys(df[c]), name), F.lit(False))
            out = F.when(has, F.try_variant_get(F.try_parse_json(df[c]), f"$['{name}']", "string")).otherwise(out)
    return out


def is_english(c: Column) -> Column:
    folded = F.translate(F.lower(strip(c)), "_", "-")
    return F.coalesce(folded.isin(*ENGLISH) | folded.startswith("en-"), F.lit(False))


def _numeric(c: Column) -> Column:
    return c.cast("double")


def condition(df: DataFrame, key: str, wanted: object) -> Column | None:
    """One filter as a condition; None if the key means nothing."""
    if key == "language":
        if str(wanted).strip().lower().replace("_", "-") not in ENGLISH:
            raise ValueError(f"unsupported language filter: {wanted!r}")
        c = field(df, "language")
        many = "language" in df.columns and isinstance(df.schema["language"].dataType, T.ArrayType)
        return F.coalesce(F.exists(c, is_english), F.lit(False)) if many else is_english(c)
    name, _, how = key.rpartition("_")
    if not name or how not in ("min", "max", "in"):
        return None
    c = field(df, name)
    if how == "in":
        if not isinstance(wanted, list | tuple | set | frozenset):
            raise ValueError(f"{key} needs a list")
        known = [w for w in wanted if w is not None]
        hit = F.coalesce(c.isin(known), F.lit(False)) if known else F.lit(False)
        return hit | c.isNull() if None in wanted else hit
    bound = F.lit(float(wanted))
    if key in SPECIAL:
        return c.isNotNull() & F.coalesce(~(_numeric(c) < bound), F.lit(False))
    if how == "min":
        return F.coalesce((_numeric(c) >= bound) & ~F.isnan(_numeric(c)), F.lit(False))
    return F.coalesce(_numeric(c) < bound, F.lit(False))


def conditions(df: DataFrame, filters: Mapping[str, object]) -> Column:
    """All filters at once; without filters every row passes."""
    found = [c for k, v in filters.items() if (c := condition(df, k, v)) is not None]
    return reduce(lambda a, b: a & b, found, F.lit(True))
