"""People and groups of a document: merged rosters, resolved parties, joint signers, matches with a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def _first(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return rows.withColumn("__place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__place = 1").drop("__place")


def merge_roster(appointments: DataFrame, specimens: DataFrame) -> DataFrame:
    """(doc, name, title, appointed, signed): one row per person of a document, by normalised name.

    Both inputs have (doc, ordinal, name, title).  Appointments are read before
    specimens, and the first value that is there counts.  Unreadable or empty names
    are never merged.
    """
    rows = appointments.select("doc", "ordinal", "name", "title", F.lit(0).alias("rank")).unionByName(specimens.select("doc", "ordinal", "name", "title", F.lit(1).alias("rank")))
    plain = F.coalesce(T.tr_normalize(F.col("name")), F.lit(""))
    alone = F.when(plain.isin("", "unreadable"), F.struct("rank", "ordinal"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("rank", "ordinal", c)))[c].alias(c)
    merged = rows.groupBy("doc", plain.alias("plain"), alone.alias("alone")).agg(first("name"), first("title"), F.bool_or(F.col("rank") == 0).alias("appointed"), F.bool_or(F.col("rank") == 1).alias("signed"))
    return merged.select("doc", "name", "title", "appointed", "signed")


def resolve_parties(parties: DataFrame, people: DataFrame, groups: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``parties`` (doc, party, kind, ref, name) with ``found`` (GROUP, PERSON or UNRESOLVED) and ``target``.

    A GROUP takes the roster's own spelling of its code, else what is printed.  Anyone
    else is looked up as a person by name, then as a group by the code of the name.
    ``people`` and ``groups`` have (doc, ordinal, name); the first of equals counts.  What
    neither knows is a group if one of ``hints`` (doc, hint) names it: one word as a word
    of its own, several as they stand.
    """
    named = people.select("doc", "ordinal", F.col("name").alias("person"), T.tr_normalize(F.col("name")).alias("plain")).filter("plain <> ''")
    coded = groups.select("doc", "ordinal", F.col("name").alias("spelling"), T.group_code(F.col("name")).alias("code")).filter("code <> ''")
    named, coded = _first(named, ["doc", "plain"], "ordinal").drop("ordinal"), _first(coded, ["doc", "code"], "ordinal").drop("ordinal")
    is_group = F.col("kind") == "GROUP"
    rows = parties.withColumns({"plain": F.when(~is_group, T.tr_normalize(F.col("name"))), "code": T.group_code(F.when(is_group, F.col("ref")).otherwise(F.col("name")))})
    rows = rows.join(named, ["doc", "plain"], "left").join(coded, ["doc", "code"], "left")
    hinted = F.lit(False)
    if hints is not None:
        rows = rows.join(hints.groupBy("doc").agg(F.collect_list(T.tr_normalize(F.col("hint"))).alias("hints")), "doc", "left")
        alone = ~F.col("plain").contains(" ")
        hinted = F.coalesce((F.col("plain") != "") & F.exists("hints", lambda h: F.when(alone, F.array_contains(F.split(h, " "), F.col("plain"))).otherwise(h.contains(F.col("plain")))), F.lit(False))
    found = F.when(is_group, "GROUP").when(F.col("person").isNotNull(), "PERSON").when(F.col("spelling").isNotNull() | hinted, "GROUP").otherwise("UNRESOLVED")
    target = F.when(is_group, F.coalesce("spelling", "ref")).otherwise(F.coalesce("person", "spelling", F.when(hinted, F.col("name"))))
    return rows.select(*parties.columns, found.alias("found"), target.alias("target"))


def joint_signers(resolved: DataFrame) -> DataFrame:
    """(doc, rule, signers): distinct targets in printed order; null where a party of the rule is unresolved."""
    one = resolved.groupBy("doc", "rule", "target").agg(F.min("party").alias("party"), F.bool_and(F.col("found") != "UNRESOLVED").alias("known"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("party", "target"))), lambda p: p.target)
    return one.groupBy("doc", "rule").agg(F.bool_and("known").alias("known"), names.alias("names")).select("doc", "rule", F.when(F.col("known"), F.col("names")).alias("signers"))


def unique_active(people: DataFrame, registry: DataFrame) -> DataFrame:
    """``people`` (company, person, tckn, name) with ``rep``: the one registry row whose masked id or name is theirs, if ACTIVE.

    No pair is built: of the registry rows of a mask or name only the smallest and the
    largest rep are kept, and who meets one rep alone has the same for both.
    """
    keyed = lambda df, id: df.select("company", id, T.masked_id(F.col("tckn")).alias("mask"), T.tr_normalize(F.col("name")).alias("plain"))
    own, reps = keyed(people, "person"), keyed(registry, "rep").filter("rep is not null")
    ends = lambda k: reps.filter(F.col(k) != "").groupBy("company", k).agg(F.min("rep").alias(f"{k}_least"), F.max("rep").alias(f"{k}_most"))
    met = own.join(ends("mask"), ["company", "mask"], "left").join(ends("plain"), ["company", "plain"], "left")
    least, most = (f(f"mask_{end}", f"plain_{end}") for f, end in ((F.least, "least"), (F.greatest, "most")))
    met = met.groupBy("company", "person").agg(F.min(least).alias("rep"), F.max(most).alias("most")).filter("rep = most")
    single = registry.groupBy("company", "rep").agg(F.count("*").alias("n"), F.first("status").alias("status")).filter("n = 1 and status = 'ACTIVE'")
    one = met.join(single.select("company", "rep"), ["company", "rep"], "left_semi")
    return people.join(one.select("company", "person", "rep"), ["company", "person"], "left")
