"""Record tags: a map from name and type class ("NM:i") to struct<t, v>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "map<string,struct<t:string,v:string>>"


#: A tag as text; an empty field isn't one.
FORM = "^[A-Za-z][A-Za-z0-9]:[AifZBH]:"


def well_formed(field: Column) -> Column:
    """A tag, or nothing at all."""
    return (field == "") | field.rlike(FORM)


def parse(fields: Column) -> Column:
    """From an array of 'NM:t:value' texts. A repeated tag keeps its last value; A and i of one name are one class."""
    one = lambda f: F.struct(
        F.concat_ws(":", F.substring(f, 1, 2), F.when(F.substring(f, 4, 1) == "A", "i").otherwise(F.substring(f, 4, 1))).alias("key"),
        F.struct(F.substring(f, 4, 1).alias("t"), F.substring(f, F.lit(6), F.length(f)).alias("v")).alias("value"),
    )
    entries = F.transform(F.filter(fields, lambda f: f.rlike(FORM)), one)
    # The last of equal keys stays, where the first stood.
    last = F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])) == 0)
    return F.map_from_entries(last)


def text(tags: Column, sort: bool = True) -> Column:
    """'NM:t:value' fields joined by tabs, by name if sorted."""
    entries = F.map_entries(tags)
    entries = F.array_sort(entries) if sort else entries
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", F.substring(e["key"], 1, 2), e["value"]["t"], e["value"]["v"])), "\t")


def value(tags: Column, name: str, kind: str = "Z") -> Column:
    return tags[f"{name}:{'i' if kind == 'A' else kind}"]["v"]


def integer(tags: Column, name: str) -> Column:
    return value(tags, name, "i").try_cast("int") if hasattr(Column, "try_cast") else value(tags, name, "i").cast("int")


def put(tags: Column, name: str, kind: str, v: Column) -> Column:
    """Set one tag; a null value leaves the tags as they are."""
    entry = F.create_map(F.lit(f"{name}:{kind}"), F.struct(F.lit(kind).alias("t"), v.alias("v")))
    kept = F.map_filter(F.coalesce(tags, F.create_map().cast(TYPE)), lambda k, _: k != f"{name}:{kind}")
    return F.when(v.isNull(), tags).otherwise(F.map_concat(kept, entry))


def remove(tags: Column, names: list[str]) -> Column:
    """Drop tags by 'NM' (any type) or 'NM:t'."""
    plain, typed = [n for n in names if ":" not in n], [n.replace(":A", ":i") for n in names if ":" in n]
    gone = lambda k: F.substring(k, 1, 2).isin(plain) | k.isin(typed)
    return F.map_filter(tags, lambda k, _: ~gone(k)) if names else tags


def names(listed: str) -> list[str]:
    """'XT:Z,NM:i;RG' to its parts; both separators occur."""
    return [x for x in listed.replace(";", ",").split(",") if x]
