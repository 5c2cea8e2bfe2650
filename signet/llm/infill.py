"""Fill-in-the-middle transformation (operator 13).

A text is an array of code points (UTF-32 in numpy).  Each point has a class; a unit
ends where the classes of two neighbours say so, so ``flatnonzero`` gives all
boundaries at once.  Two cuts, drawn from a digest of seed and id, are ranks among
them; the pieces are slices, encoded again, and set in one of two orders behind marks.

One Arrow pass without a shuffle; a row's result depends on its id and text alone,
so reruns and recomputed tasks agree.  Getting the text back is a split at the marks,
in Spark's own functions.

Null texts are empty; empty texts, texts that hold a mark and those the rate leaves
out stay plain, whole.  A null id counts as '' in the digest.  Repeated rows get equal
results.  Columns named as the results are replaced, others stay.  No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
NEWLINE = np.array([10], np.uint32)
SPACES = np.array([32, 9, 10, 11, 12, 13], np.uint32)
#: By unit: the code points of class 1, and whether a unit ends between a class (row) and the next one (column).
UNITS = {
    "line": (NEWLINE, np.array([[False, False], [True, True]])),
    "word": (SPACES, np.array([[False, False], [True, False]])),
}


@dataclass(frozen=True)
class Settings:
    """``rate`` of 100 texts are cut, ``spm`` of 100 of them with the suffix first; marks stand before prefix, suffix and middle."""

    seed: str = "7"
    rate: int = 100
    spm: int = 50
    unit: str = "line"
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self) -> None:
        tails = {m[i:] for m in self.marks for i in range(1, len(m))}
        if len({*self.marks}) < 3 or "" in self.marks or any(m.startswith(t) for m in self.marks for t in tails) or any(a in b for a in self.marks for b in self.marks if a != b):
            raise ValueError("marks that can overlap can't be found again")


def ends(points: np.ndarray, unit: str = "line") -> np.ndarray:
    """Where each unit of a text ends."""
    if not len(points):
        return np.zeros(0, np.int64)
    members, breaks = UNITS[unit]
    kind = np.isin(points, members).astype(np.int8)
    return np.append(np.flatnonzero(breaks[kind[:-1], kind[1:]]) + 1, len(points))


def transformed(key: str, text: str, own: Settings) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    stops = np.concatenate([[0], ends(points, own.unit)])
    n = len(stops) - 1
    digest = hashlib.sha256(f"{own.seed}:{key}".encode()).hexdigest()
    one, two, drawn, order = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not n or drawn % 100 >= own.rate or any(m in text for m in own.marks):
        return n, "plain", None, None, text
    a, b = (int(stops[i]) for i in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(points))))
    p, s, m = own.marks
    if order % 100 < own.spm:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def infill(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n, form, prefix_chars, middle_chars and output."""
    docs = docs.drop(*ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                keys = ("" if i is None else str(i) for i in some.column("doc_id").to_pylist())
                made = [transformed(k, t.as_py() or "", settings) for k, t in zip(keys, some.column("text"), strict=True)]
                found = [pa.array([row[i] for row in made], pa.string() if kind == "string" else pa.int64()) for i, kind in enumerate(ADDED.values())]
                yield pa.RecordBatch.from_arrays([*some.columns, *found], names=[*some.schema.names, *ADDED])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join([*kept, *(f"{c} {t}" for c, t in ADDED.items())]))


def restored(output: Column | str = "output", form: Column | str = "form", settings: Settings = Settings()) -> Column:
    """The text that ``output`` was made of: its pieces between the marks, in their order."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in settings.marks), -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), l AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines,
    list_transform([0, 1, 2, 3], lambda i: list_reduce(list_transform(range(8 * i + 1, 8 * i + 9), lambda j: CAST(instr('0123456789abcdef', substr(h, j, 1)) - 1 AS BIGINT)), lambda a, x: 16 * a + x)) AS draws FROM d
), c AS (
  SELECT *, len(lines) AS n, draws[1] % (len(lines) + 1) AS one, draws[2] % (len(lines) + 1) AS two,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR draws[3] % 100 >= 100 THEN 'plain' WHEN draws[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l
), p AS (
  SELECT doc_id, t, n, form, array_to_string(lines[1:least(one, two)], '') AS prefix, array_to_string(lines[least(one, two) + 1:greatest(one, two)], '') AS middle,
    array_to_string(lines[greatest(one, two) + 1:], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
