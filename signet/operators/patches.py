"""Corrections applied to nested payloads by path: typed, checked against the schema, and without a detour over JSON.

A path names a field as ``company.name``, an element of an array of structs by its id as
``representatives[rep-1].mode``.  The payload's type says which paths exist and what their
values must parse to; a correction that fits neither is an error, or listed, never lost.
Corrections of one document are gathered in one row, so documents are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: A derived field: the field beside it that it follows, and how.
Derived = Mapping[str, tuple[str, Callable[[Column], Column]]]


def _keyed(kind: S.DataType, id: str) -> bool:
    return isinstance(kind, S.ArrayType) and isinstance(kind.elementType, S.StructType) and id in kind.elementType.names


def fields(schema: S.StructType, id: str = "id", at: str = "") -> list[tuple[str, S.DataType]]:
    """Every scalar field of a payload as (pattern, type); elements of arrays by id show as ``[]``."""
    found = []
    for f in schema:
        path = f"{at}{f.name}"
        if isinstance(f.dataType, S.StructType):
            found += fields(f.dataType, id, f"{path}.")
        elif _keyed(f.dataType, id):
            found += [(p, t) for p, t in fields(f.dataType.elementType, id, f"{path}[].") if p != f"{path}[].{id}"]
        elif not isinstance(f.dataType, S.ArrayType | S.MapType):
            found.append((path, f.dataType))
    return found


def value_at(payload: Column, schema: S.StructType, path: str, id: str = "id") -> Column:
    """What a payload has at ``path``; null where no element has the id.  Raises for a path that the schema doesn't know."""
    column, kind = payload, schema
    for step in path.split("."):
        name, _, key = step.rstrip("]").partition("[")
        if not isinstance(kind, S.StructType) or name not in kind.names:
            raise KeyError(path)
        column, kind = column[name], kind[name].dataType
        if key:
            if not _keyed(kind, id):
                raise KeyError(path)
            column, kind = F.get(F.filter(column, _has(id, key)), 0), kind.elementType
    return column


def _has(id: str, key: str) -> Callable[[Column], Column]:
    return lambda x: x[id] == key


def _each(within: Callable[..., Column], path: Column, id: str) -> Callable[[Column], Column]:
    """``within`` for an element of an array, told how paths within it begin."""
    return lambda x: within(x, at=F.concat(path, F.lit("["), x[id].cast("string"), F.lit("].")))


def _known(payload: Column, schema: S.StructType, editable: set[str], id: str, at: Column, shape: str = "") -> Column:
    """The paths that may be corrected in this payload, each with its type's name."""
    lists = []
    for f in schema:
        path, pattern, kind = F.concat(at, F.lit(f.name)), f"{shape}{f.name}", f.dataType
        if isinstance(kind, S.StructType):
            lists.append(_known(payload[f.name], kind, editable, id, F.concat(path, F.lit(".")), f"{pattern}."))
        elif _keyed(kind, id):
            own = F.filter(payload[f.name], lambda x: x[id].isNotNull())
            within = partial(_known, schema=kind.elementType, editable=editable, id=id, shape=f"{pattern}[].")
            lists.append(F.flatten(F.transform(own, _each(within, path, id))))
        elif pattern in editable:
            lists.append(F.array(path))
    empty = F.array().cast("array<string>")
    return F.when(payload.isNotNull(), F.concat(*(F.coalesce(x, empty) for x in lists)) if lists else empty)


def _rebuilt(payload: Column, schema: S.StructType, changes: Column, editable: set[str], derived: Derived, id: str, at: Column, shape: str = "") -> Column:
    made = []
    for f in schema:
        column, path, pattern, kind = payload[f.name], F.concat(at, F.lit(f.name)), f"{shape}{f.name}", f.dataType
        if isinstance(kind, S.StructType):
            new = _rebuilt(column, kind, changes, editable, derived, id, F.concat(path, F.lit(".")), f"{pattern}.")
        elif _keyed(kind, id):
            within = partial(_rebuilt, schema=kind.elementType, changes=changes, editable=editable, derived=derived, id=id, shape=f"{pattern}[].")
            new = F.transform(column, _each(within, path, id))
        elif pattern in derived:
            beside, how = derived[pattern]
            source = F.concat(at, F.lit(beside))
            new = F.when(F.map_contains_key(changes, source), how(F.element_at(changes, source)).cast(kind)).otherwise(column)
        elif pattern in editable:
            new = F.when(F.coalesce(F.map_contains_key(changes, path), F.lit(False)), F.try_element_at(changes, path).try_cast(kind)).otherwise(column)
        else:
            new = column
        made.append(new.alias(f.name))
    return F.when(payload.isNotNull(), F.struct(*made))


def effective(rows: DataFrame, corrections: DataFrame, key: str, editable: list[str] | None = None, derived: Derived | None = None, payload: str = "payload", id: str = "id", strict: bool = True) -> DataFrame:
    """``rows`` (key, payload, ...) with ``corrections`` (key, seq, path, value as text) applied, the last of each path.

    ``editable`` patterns (all scalar fields if None) may be corrected; ``derived`` fields
    follow the field beside them when that is corrected.  A null value empties a field.  A
    path that the payload doesn't have, or a value that doesn't parse, raises; without
    ``strict`` such paths are in ``refused`` (sorted; empty if none) and change nothing.
    A null path is refused as '' and a null payload refuses all.  Of corrections with one
    seq that of the greater value counts.
    """
    schema = rows.schema[payload].dataType
    kinds = dict(fields(schema, id))
    allowed = set(kinds if editable is None else editable) - set(derived or {})
    if unknown := allowed - kinds.keys():
        raise KeyError(f"no such fields: {sorted(unknown)}")
    last = corrections.groupBy(key, F.coalesce("path", F.lit("")).alias("path")).agg(F.max(F.struct("seq", "value")).alias("new"))
    texts = last.select(key, "path", F.col("new.value").alias("value"))
    given = texts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("__changes"))
    both = rows.join(given, key, "left").withColumn("__changes", F.coalesce("__changes", F.create_map().cast("map<string,string>")))
    known = _known(F.col(payload), schema, allowed, id, F.lit(""))
    shape = lambda path: F.regexp_replace(path, r"\[[^\]]*\]", "[]")

    def parses(path: Column, value: Column) -> Column:
        """Whether a value is null or reads as its field's type."""
        found = F.lit(True)
        for pattern, kind in kinds.items():
            if pattern in allowed and not isinstance(kind, S.StringType):
                found = F.when(shape(path) == pattern, value.isNull() | value.try_cast(kind).isNotNull()).otherwise(found)
        return found

    both = both.withColumn("__known", F.coalesce(known, F.array().cast("array<string>")))
    refused = F.array_sort(F.map_keys(F.map_filter("__changes", lambda p, v: ~(F.array_contains("__known", p) & parses(p, v)))))
    both = both.withColumn("refused", refused)
    if strict:
        both = both.withColumn("__changes", F.when(F.size("refused") == 0, F.col("__changes")).otherwise(F.raise_error(F.concat(F.lit("no such path or value: "), F.array_join("refused", ", ")))))
    else:
        both = both.withColumn("__changes", F.map_filter("__changes", lambda p, _: ~F.array_contains("refused", p)))
    made = both.withColumn(payload, _rebuilt(F.col(payload), schema, F.col("__changes"), allowed, derived or {}, id, F.lit("")))
    return made.select(*rows.columns, *([] if strict else ["refused"]))
