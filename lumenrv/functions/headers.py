"""Headers as maps: typed values, wildcards, numbered lists, translated keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_of(header: Column, keys: Sequence[str], kind: str = "string", required: bool = False) -> Column:
    """The first of some keys that a header has, cast; null (or an error, if required) without any."""
    found = F.coalesce(*(F.try_element_at(header, F.lit(k)) for k in keys))
    if required:
        found = F.coalesce(found, F.raise_error(F.lit(f"no key of {', '.join(keys)}")).cast("string"))
    return found if kind == "string" else found.try_cast(kind)


def matching(header: Column, pattern: str) -> Column:
    """The part of a header whose keys fit a pattern with * and ?."""
    regex = "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != " " else c for c in pattern) + "$"
    return F.map_filter(header, lambda k, v: k.rlike(regex))


def paired_value(header: Column, name_key: str, value_key: str, wanted: str, n: int) -> Column:
    """The value of a numbered key whose partner of the same number holds a name, as in NAME1/VALUE1, NAME2/VALUE2."""
    pairs = [F.when(F.try_element_at(header, F.lit(name_key.format(i))) == wanted, F.try_element_at(header, F.lit(value_key.format(i)))) for i in range(1, n + 1)]
    return F.coalesce(*pairs)


def numbered_list(header: Column, template: str, rows: int, columns: int) -> Column:
    """rows x columns doubles from keys of a template such as WAVE%04d, counted along the rows."""
    cell = lambda r, c: F.try_element_at(header, F.format_string(template, r * columns + c)).try_cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: cell(r, c)))


def translated(header: Column, names: Mapping[str, str], constants: Mapping[str, str] | None = None) -> Column:
    """A header under other key names; keys that are not named stay, constants are put over both."""
    renamed = F.transform_keys(header, lambda k, v: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), k), k))
    return F.map_concat(F.map_filter(renamed, lambda k, v: ~k.isin(*(constants or {"": ""}))), F.create_map(*(F.lit(x) for kv in (constants or {}).items() for x in kv))) if constants else renamed


def ascii_header(header: Column, forbidden: Sequence[str] = ()) -> Column:
    """What may be written: ASCII values of 75 characters at most, without forbidden keys."""
    clean = F.transform_values(header, lambda k, v: F.regexp_replace(v, r"[^\x00-\x7F]", ""))
    return F.map_filter(clean, lambda k, v: (F.length(v) <= 75) & ~k.isin(*forbidden, ""))
