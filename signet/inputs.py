"""The driver's tables as the engine's own inputs: SELECTs that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["customer", "supplier", "orders", "lineitem", "events", "documents", "nation"]
_NAMED = re.compile(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b")


def rows(spark: SparkSession, sf_dir: str, sql: str, by: str | None = None) -> DataFrame:
    """What ``sql`` gives over the tables it names; no view of theirs stays in the session.

    With ``by`` the tables come partitioned by this column: groups that include it, and
    what later meets or is grouped by it alone, need no shuffle of their own.
    """
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for _, name in _NAMED.findall(sql)}
    return over(spark, sql, {name: table.repartition(by) for name, table in tables.items()} if by else tables)


def over(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """What ``sql`` gives over the given tables; they may be streams."""
    plain = sql.replace("{", "{{").replace("}", "}}").replace(" // ", " div ")
    real = {f.name for table in tables.values() for f in table.schema if f.dataType.typeName() in ("float", "double")}
    if real:  # a cast to a whole number rounds in DuckDB and cuts in Spark
        plain = re.sub(rf"\bCAST\(([^()]*\b(?:{'|'.join(sorted(real))})\b[^()]*) AS BIGINT\)", r"CAST(rint(\1) AS BIGINT)", plain)
    return spark.sql(_NAMED.sub(r"\1 {\2}", plain), **tables)


def given(inputs: dict[str, str], *names: str, more: str = "") -> str:
    """The same SELECTs as the WITH of a query."""
    return f"WITH {more}" + ", ".join(f"{n} AS ({inputs[n]})" for n in names)


def normal(x: str) -> str:
    """SQL of a normalised text."""
    return f"trim(regexp_replace(replace(strip_accents(lower(translate({x}, 'Iİ', 'ıi'))), 'ı', 'i'), '[^0-9a-z]+', ' ', 'g'))"


def group_code(x: str) -> str:
    """SQL of a group's code, with its own lists of words."""
    left = f"trim(regexp_replace(' ' || replace(coalesce({normal(x)}, ''), ' ', '  ') || ' ', ' (grup|grubu|derece|derecesi|imza|yetkili|yetkilisi|yetkilileri) ', ' ', 'g'))"
    ranks = {"birinci": 1, "i": 1, "ikinci": 2, "ii": 2, "ucuncu": 3, "iii": 3, "dorduncu": 4, "iv": 4, "besinci": 5, "v": 5, "altinci": 6, "vi": 6}
    return f"(CASE {left} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ranks.items())} ELSE regexp_replace({left}, ' +', ' ', 'g') END)"


def ratios(pairs: str, threshold: float) -> str:
    """CTEs that add ``scored`` (the columns of ``pairs`` with score) to a WITH RECURSIVE: longest common subsequences letter by letter.

    ``pairs`` has id, a and b.  Pairs that lengths rule out aren't compared.
    """
    step = "list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN b[k] = a[i + 1] THEN coalesce(line[k - 1], 0) + 1 ELSE line[k] END)))"
    return f"""asked AS (SELECT DISTINCT a, b FROM {pairs} WHERE 200 * least(length(a), length(b)) >= {threshold} * (length(a) + length(b))),
        lcs AS (SELECT a, b, 0 AS i, list_transform(range(1, len(b) + 1), lambda j: 0::BIGINT) AS line FROM asked UNION ALL SELECT a, b, i + 1, {step} FROM lcs WHERE i < length(a)),
        lengths AS (SELECT a, b, CASE WHEN len(a) + len(b) = 0 THEN 100.0 ELSE 200.0 * coalesce(line[len(b)], 0) / (len(a) + len(b)) END AS score FROM lcs WHERE i = length(a)),
        scored AS (SELECT p.*, l.score FROM {pairs} p JOIN lengths l ON l.a = p.a AND l.b = p.b WHERE l.score >= {threshold})"""
