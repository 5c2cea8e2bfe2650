"""What a document's people and rules mean for a bank: who may sign alone, up to how much, and executable rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Tags of a rule that aren't a scope, and the scope of a rule without one.
NOT_SCOPES, ANY_SCOPE = ["unlimited"], "general"


def numbered(signatories: DataFrame) -> DataFrame:
    """``signatories`` with ``rep``: their names in the flat document, by place."""
    return signatories.withColumn("rep", F.format_string("rep-%d", F.col("sig") + 1))


def resolved(rules: DataFrame, parties: DataFrame, signatories: DataFrame) -> DataFrame:
    """``rules`` (doc, rule, ...) with ``known``, whether each of its parties stands for somebody, ``first``, whoever its item 0 stands for, and ``sigs``, everyone who signs it in printed order, each as (sig, name).

    ``parties`` has (doc, rule, item, type, ref): who is item 0, the others follow.  A
    person's ref is the signatory's id (sig-n), a group's its name; it stands for all of
    its code.  ``sigs`` is null where a party stands for nobody or a rule has no parties;
    a null type or ref stands for nobody, and repeated parties count once.  Parties meet
    the people of their document, then the rules, all on one partitioning by document.
    ``known`` needs no lambda, and where only it is read nothing else is gathered.
    """
    of_group = F.col("type") == "group"
    person = F.struct("sig", "name", F.concat(F.lit("sig-"), (F.col("sig") + 1).cast("string")).alias("ref"), T.group_code(F.col("group_name")).alias("code"))
    some = signatories.filter("sig is not null").withColumn("person", person)
    folk = some.groupBy("doc").agg(F.array_sort(F.collect_set("person")).alias("folk"), F.collect_set("person.ref").alias("refs"), F.collect_set("person.code").alias("codes"))
    asked = parties.select("doc", "rule", "item", "type", "ref", T.group_code(F.when(of_group, F.col("ref"))).alias("code")).join(folk, "doc", "left")
    hit = ((F.col("type") == "person") & F.array_contains("refs", F.col("ref"))) | ((F.col("code") != "") & F.array_contains("codes", F.col("code")))
    meant = lambda f: ((F.col("type") == "person") & (f["ref"] == F.col("ref"))) | ((F.col("code") != "") & (f["code"] == F.col("code")))
    by = F.transform(F.filter("folk", meant), lambda f: F.struct(f["sig"].alias("sig"), f["name"].alias("name")))
    stood = asked.groupBy("doc", "rule").agg(F.min(F.coalesce(hit, F.lit(False))).alias("known"), F.array_sort(F.collect_set(F.struct("item", "type", "ref", by.alias("by")))).alias("stood"))
    both = rules.withColumn("told", F.lit(True)).unionByName(stood, allowMissingColumns=True)
    of_rule = W.partitionBy("doc", "rule")  # a null rule's parties are those of null rules
    rows = both.withColumns({"known": F.coalesce(F.max("known").over(of_rule), F.lit(False)), "stood": F.coalesce(F.first("stood", ignorenulls=True).over(of_rule), F.array().cast(stood.schema["stood"].dataType))})
    everyone = F.array_distinct(F.flatten(F.transform("stood", lambda s: s["by"])))
    first = F.flatten(F.transform(F.filter("stood", lambda s: s["item"] == 0), lambda s: s["by"]))
    return rows.filter("told").select(*rules.columns, "known", first.alias("first"), F.when(F.col("known"), everyone).alias("sigs"))


def scopes(tags: Column) -> Column:
    """Distinct scopes of a rule in order; a rule without one has the general scope."""
    kept = F.array_except(tags, F.array(*map(F.lit, NOT_SCOPES), F.lit(None)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(ANY_SCOPE)))


def flat_rules(rules: DataFrame, parties: DataFrame, signatories: DataFrame) -> DataFrame:
    """(doc, rule, scope, threshold, mode, signers, blocked, unresolved): one row for each scope of a rule that isn't from an annex.

    ``rules`` has (doc, rule, form, amount_max, scope_tags, scope_text, quote, source).
    A rule that excludes what it names, or whose joint signers aren't all known, is blocked.
    """
    excluded = T.says_blocked(F.col("scope_text"), F.col("quote"))
    usable = rules.filter("source != 'annex'").select("doc", "rule", "form", "amount_max", "scope_tags", excluded.alias("excluded"))
    rows = resolved(usable, parties, signatories)
    open_ = (F.col("form") == "joint") & ~F.col("known") & ~F.col("excluded")
    rows = rows.withColumns({"unresolved": open_, "blocked": F.col("excluded") | open_})
    signers = F.when(~F.col("blocked") & (F.col("form") == "joint"), F.transform("sigs", lambda s: F.format_string("rep-%d", s["sig"] + 1))).otherwise(F.array().cast("array<string>"))
    mode = F.when(~F.col("blocked"), F.upper("form"))
    return rows.select("doc", "rule", F.explode(scopes(F.col("scope_tags"))).alias("scope"), F.col("amount_max").alias("threshold"), mode.alias("mode"), signers.alias("signers"), "blocked", "unresolved")


def people(signatories: DataFrame, rules: DataFrame, parties: DataFrame) -> DataFrame:
    """(doc, sig, rep, mode, max_amount, co_signers, uncertain) for each of ``signatories`` (doc, sig, name, group_name, form, joint_names).

    Whoever a sole rule names may sign alone, up to the largest of its general rules (of
    all, if there is none; open if one is open).  Else joint rules that name the person
    decide, with the others' names after the printed ones; else the printed form.  What is
    gathered is one document's rules.
    """
    general = F.coalesce(F.array_contains("scope_tags", ANY_SCOPE), F.lit(False))
    usable = rules.filter(~T.says_blocked(F.col("scope_text"), F.col("quote")) & F.col("form").isin("sole", "joint")).select("doc", "rule", "form", "amount_max", general.alias("general"))
    of_doc = resolved(usable, parties, signatories).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("rule", "form", "amount_max", "general", "first", "sigs"))).alias("rules"))
    names_one = lambda who: F.exists(who, lambda x: x["sig"] == F.col("sig"))
    alone = F.filter("rules", lambda r: (r["form"] == "sole") & names_one(r["first"]))
    shared = F.filter("rules", lambda r: (r["form"] == "joint") & names_one(r["sigs"]))
    rows = signatories.join(of_doc, "doc", "left").withColumns({"alone": alone, "shared": shared})
    of_general = F.filter("alone", lambda r: r["general"])
    counted = F.when(F.size(of_general) > 0, of_general).otherwise(F.col("alone"))
    amount = F.when(~F.exists(counted, lambda r: r["amount_max"].isNull()), F.array_max(F.transform(counted, lambda r: r["amount_max"])))
    others = F.flatten(F.transform("shared", lambda r: F.transform(F.filter(r["sigs"], lambda x: x["sig"] != F.col("sig")), lambda x: x["name"])))
    plain = F.coalesce(T.tr_normalize(F.col("form")), F.lit(""))
    is_sole, is_joint = (F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("alone", "shared"))
    none = F.array().cast("array<string>")
    printed = F.coalesce("joint_names", none)
    mode = F.when(is_sole, "SOLE").when(is_joint, "JOINT").when(plain.contains("munferit"), "SOLE").otherwise("JOINT")
    co = F.when(is_sole, none).when(is_joint, F.array_distinct(F.filter(F.concat(printed, F.coalesce(others, none)), lambda n: n != ""))).when(plain.contains("munferit"), none).otherwise(printed)
    uncertain = ~is_sole & ~is_joint & ~plain.contains("munferit") & ~plain.contains("musterek")
    return rows.select("doc", "sig", F.format_string("rep-%d", F.col("sig") + 1).alias("rep"), mode.alias("mode"), amount.alias("max_amount"), co.alias("co_signers"), uncertain.alias("uncertain"))


def evidence(documents: DataFrame, rules: DataFrame, signatories: DataFrame, companies: DataFrame) -> DataFrame:
    """(doc, quote, page): the clause that shows a document's authority, the first readable of rules, people and company; fixed values: UNREADABLE on page 1."""
    readable = F.col("quote") != "UNREADABLE"
    of_rules = rules.filter((F.col("source") != "annex") & readable).groupBy("doc").agg(F.min(F.struct("partial", (F.col("source") != "circular").alias("o"), "page", "rule", "quote")).alias("r"))
    of_people = signatories.filter(readable & F.col("page").isNotNull()).groupBy("doc").agg(F.min(F.struct("sig", "quote", "page")).alias("s"))
    of_company = companies.filter("quote is not null").groupBy("doc").agg(F.min(F.struct("item", "quote", "page")).alias("c"))
    rows = documents.select("doc").join(of_rules, "doc", "left").join(of_people, "doc", "left").join(of_company, "doc", "left")
    return rows.select("doc", F.coalesce("r.quote", "s.quote", "c.quote", F.lit("UNREADABLE")).alias("quote"), F.coalesce("r.page", "s.page", "c.page", F.lit(1)).alias("page"))
