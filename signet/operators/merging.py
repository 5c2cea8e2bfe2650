"""Rules that several readings gave, merged by identity and fuzzy quotes, with their source and confidence.

Rules of one identity (document, page, amounts, currency, form, parties, date) are few,
so a group is one task's work; the merge within it is sequential by nature, for each
survivor can take the quote of the rule it swallowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..functions import text as T
from ..storage import cut
from . import matching

IDENTITY = ["doc", "kind", "page", "amount_min", "amount_max", "money", "form", "parties", "until"]


def party_key(party: Column) -> Column:
    """A party (type, ref, name) as one text that equal parties share."""
    kind, ref, name = party["type"], F.coalesce(party["ref"], F.lit("")), F.coalesce(party["name"], F.lit(""))
    return F.concat_ws("/", kind, F.when(kind == "group", T.group_code(ref)).otherwise(T.tr_normalize(ref)), T.tr_normalize(name))


def signing_key(form: Column | str, who: Column | str, joint: Column | str) -> Column:
    """All parties of a rule: in any order if they sign together, else who signs first and the others in any order."""
    form, who, joint = (F.col(x) if isinstance(x, str) else x for x in (form, who, joint))
    first, others = F.array(party_key(who)), F.array_sort(F.transform(joint, party_key))
    every = F.concat(first, others)
    return F.array_join(F.when(form == "joint", F.array_sort(every)).otherwise(every), ";")


def candidates(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """``raw`` rules with ``kind``: primary, supporting or witness.

    ``raw`` has (doc, ordinal, agent, role, supporting, page, ...), ``pages`` (doc, page,
    annex): pages that only have annexes.  A witness stays one wherever it reads.
    """
    marked = raw.join(pages.filter("annex").select("doc", "page").distinct().withColumn("annex", F.lit(True)), ["doc", "page"], "left")
    weak = F.col("supporting") | F.coalesce("annex", F.lit(False))
    kind = F.when(F.col("role") == "witness", "witness").when(weak | (F.col("agent") == "annex"), "supporting").otherwise("primary")
    return marked.withColumn("kind", kind).drop("annex")


#: What the fold of a group looks at; the rest of a row only comes along.
FOLDED = ["ordinal", "place", "plain", "quote", "partial", "scope_tags", "tag_keys", "scope_text", "scope_size"]
_score = lru_cache(1 << 16)(matching.indel_ratio)


def _join(found: list[dict], row: dict, threshold: float) -> None:
    """Puts ``row`` into the survivor of ``found`` whose quote is nearest, or behind them all."""
    tags = list(zip(row["tag_keys"] or [], row["scope_tags"] or [], strict=True))
    own = row | {"first": row["ordinal"], "score": (not row["partial"], len(row["quote"] or "")), "tags": tags, "scope": (row["scope_size"] or 0, row["scope_text"])}
    plain = row["plain"] or ""
    scored = [(100.0 if plain == (other["plain"] or "") else _score(plain, other["plain"] or ""), -k) for k, other in enumerate(found)]
    best = max((s for s in scored if s[0] >= threshold), default=None)
    if best is None:
        found.append(own)
        return
    other = found[-best[1]]
    win, lose = (own, other) if own["score"] > other["score"] else (other, own)
    known = {key for key, _ in win["tags"]}
    tags = win["tags"] + list({key: (key, tag) for key, tag in reversed(lose["tags"]) if key not in known}.values())[::-1]
    found[-best[1]] = win | {"first": other["first"], "tags": tags, "scope": own["scope"] if own["scope"][0] > other["scope"][0] else other["scope"]}


def folded(rules: DataFrame, threshold: float = 90.0) -> DataFrame:
    """``merged`` of ``rules``, and witnesses as they are, with ``plain``, the normalised quote.

    Rows come sorted by identity on a partitioning by document, in one pass: a rule that is
    alone in its identity passes as Arrow data, and of a group only the survivors are held.
    """
    keyed = rules.repartition("doc").withColumns({"money": T.tr_normalize(F.coalesce("currency", F.lit(""))), "parties": signing_key("form", "who", "joint"), "until": F.col("valid_until")})
    keyed = keyed.withColumns({"plain": T.tr_normalize(F.col("quote")), "tag_keys": F.transform("scope_tags", T.tr_normalize), "scope_size": F.length(T.tr_normalize(F.col("scope_text")))})
    by = W.partitionBy(*IDENTITY)
    n = F.when(F.col("kind") == "witness", 1).otherwise(F.count("*").over(by))
    rows = keyed.withColumns({"n": n, "place": F.row_number().over(by.orderBy("ordinal"))}).sortWithinPartitions(*IDENTITY, "ordinal")
    kept = [f for f in rows.schema if f.name not in ("n", "place")]
    schema = StructType([*kept, StructField("first", rows.schema["ordinal"].dataType), StructField("tags", rows.schema["scope_tags"].dataType), StructField("scope", rows.schema["scope_text"].dataType)])
    names, kinds = [f.name for f in kept], [to_arrow_type(f.dataType) for f in schema.fields[-3:]]

    def whole(rows: pa.RecordBatch, *made: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *made], names=[*names, "first", "tags", "scope"])

    def closed(found: list[dict]) -> Iterator[pa.RecordBatch]:
        for _, some in groupby(found, lambda f: id(f["at"][0])):
            some = list(some)
            made = [f["first"] for f in some], [[tag for _, tag in f["tags"]] for f in some], [f["scope"][1] for f in some]
            yield whole(some[0]["at"][0].take(pa.array([f["at"][1] for f in some])), *(pa.array(x, t) for x, t in zip(made, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            several, done = pc.greater(batch.column("n"), 1), []
            alone, rest = batch.filter(pc.invert(several)), batch.filter(several)
            if alone.num_rows:
                yield whole(alone, *(alone.column(c) for c in ("ordinal", "scope_tags", "scope_text")))
            for i, row in enumerate(rest.select(FOLDED).to_pylist()):
                if row["place"] == 1:
                    done, group = done + group if group else done, []
                _join(group, row | {"at": (rest, i)}, threshold)
            yield from closed(done)
            group = [f | {"at": (f["at"][0].take(pa.array([f["at"][1]])), 0)} for f in group]  # lets go of the batch
        yield from closed(group)

    return rows.mapInArrow(run, schema)


def merged(rules: DataFrame, threshold: float = 90.0) -> DataFrame:
    """Survivors of ``rules`` (doc, ordinal, kind, page, amount_min, amount_max, currency, form, who, joint, valid_until, quote, partial, scope_tags, scope_text).

    In order, each rule joins the survivor of its identity whose quote is nearest, at
    ``threshold`` or more (the first of equals).  The whole rule, then the longer quote,
    wins and brings its tags first; the longest scope text stays.  ``first`` is the place
    of the survivor's first rule, ``tags`` its tags.  Witnesses aren't merged and don't
    stay.  A null quote is an empty one, null tags are none.
    """
    return folded(rules, threshold).filter("kind != 'witness'")


def rules(raw: DataFrame, pages: DataFrame, threshold: float = 90.0) -> DataFrame:
    """(doc, ordinal, first, kind, source, confidence, tags, scope, ...): the rules of each document.

    A primary rule whose quote a witness or a supporting rule has is of high confidence,
    a partial one of low.  Supporting rules stay only if no primary quote is theirs.  Each
    quote meets the distinct quotes of the other side of its document; equal ones and those
    that lengths or letters rule out are settled without Python.  A null quote meets none;
    rules without a document are nobody's and don't stay.
    """
    rows = cut(folded(candidates(raw, pages), threshold))
    own = F.col("kind") == "primary"
    quotes = rows.groupBy("doc").agg(F.collect_set(F.when(own, F.col("plain"))).alias("primary_quotes"), F.collect_set(F.when(~own, F.col("plain"))).alias("other_quotes"))
    met = rows.filter("kind != 'witness'").join(quotes, "doc").withColumn("facing", F.when(own, F.col("other_quotes")).otherwise(F.col("primary_quotes")))
    met = met.withColumn("same", F.coalesce(F.array_contains("facing", F.col("plain")), F.lit(False)))
    none = F.array().cast("array<string>")
    near = F.when(F.col("same") | F.col("plain").isNull(), none).otherwise(F.filter("facing", lambda x: matching.possible(F.col("plain"), x, threshold)))
    met = met.withColumn("near", near).withColumn("seen", F.col("same") | matching.any_ratio(threshold)(F.transform("near", lambda x: F.col("plain")), F.col("near")))
    confidence = F.when(own & F.col("partial"), "low").when(own & F.col("seen"), "high").when(own, "medium").otherwise("low")
    kept = met.filter(own | ~F.col("seen")).withColumns({"source": F.when(own, "circular").otherwise("annex"), "confidence": confidence})
    return kept.drop("primary_quotes", "other_quotes", "facing", "same", "near", "seen")


def first_of(rows: DataFrame, key: list[str], order: str, *columns: str) -> DataFrame:
    """For each key the first value of each column that is there, by ``order``."""
    return rows.groupBy(*key).agg(*(F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in columns))


def distinct_in_order(rows: DataFrame, key: list[str], order: str, *columns: str) -> DataFrame:
    """(key, items): the distinct values of ``columns``, each where it stood first."""
    one = rows.groupBy(*key, *columns).agg(F.min(order).alias(order))
    return one.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *columns))), lambda x: x[columns[0]] if len(columns) == 1 else F.struct(*(x[c].alias(c) for c in columns))).alias("items"))


#: Fixed value: what stands for a text that nobody could read.
UNREADABLE = "UNREADABLE"


def companies(readings: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, company, notary, company_evidence, notary_evidence): what all readings of a document say of its company and notary.

    readings(doc, ordinal, company struct, company_evidence, notary struct with ``date`` as
    text, notary_evidence; evidence as arrays of (page, quote)); pages(doc, company_line).
    The company's fields are those of the first reading, whatever they hold; its evidence
    is that of all readings in their order, each (page, quote) once.  The notary and its
    evidence come from the first reading that has one, its date if it is one.  A document
    without readings has the line of its pages, or nothing readable, as legal name.  One
    aggregation, with partial sums; what is gathered is one document's evidence.
    """
    none = readings.schema["company_evidence"].dataType
    agg = readings.groupBy("doc").agg(
        F.min_by("company", "ordinal").alias("company"),
        F.array_sort(F.collect_list(F.struct("ordinal", "company_evidence"))).alias("all"),
        F.min_by(F.struct("notary", "notary_evidence"), F.when(F.col("notary").isNotNull(), F.col("ordinal"))).alias("first"),
    )
    line = F.struct(*(F.when(F.lit(f.name == "legal_name"), F.coalesce("company_line", F.lit(UNREADABLE))).cast(f.dataType).alias(f.name) for f in readings.schema["company"].dataType))
    found = agg.withColumn("read", F.lit(True)).join(pages.groupBy("doc").agg(F.min("company_line").alias("company_line")), "doc", "full")
    notary = F.col("first.notary").withField("date", T.parse_date(F.col("first.notary.date")))
    empty = F.array().cast(none)
    evidence = lambda x: F.array_distinct(F.filter(F.coalesce(x, empty), lambda e: e.isNotNull()))
    return found.select(
        "doc", F.when(F.col("read"), F.col("company")).otherwise(line).alias("company"), F.when(F.col("first.notary").isNotNull(), notary).alias("notary"),
        evidence(F.flatten(F.transform("all", lambda x: F.coalesce(x.company_evidence, empty)))).alias("company_evidence"), evidence(F.col("first.notary_evidence")).alias("notary_evidence"),
    )
