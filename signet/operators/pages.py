"""Pages of documents: labels, sections, windows, runs, and the chunks that a reader is asked about."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Labels of a page by what they do to a chunk.
ANNEX = ["ic_yonerge_annex", "board_resolution_annex", "gazette_annex", "imza_beyannamesi"]
RIDE_ALONG = ["identity_header", "dayanak", "notary_block"]
BLOCKERS = ["specimens", "gazette_annex", "imza_beyannamesi", "cover_or_blank"]
# Kinds of chunks in their order.
AGENTS = ["appointments", "rules", "specimens", "annex", "review"]
SIZE, STEP = 4, 3


def has(*labels: str) -> Column:
    """Pages with any of ``labels``."""
    return F.arrays_overlap("labels", F.array(*map(F.lit, labels)))


def annex_only() -> Column:
    """Pages that may support a rule and never create one."""
    return has(*ANNEX) & ~has("rules")


def supporting_only() -> Column:
    return F.forall("labels", lambda x: x.isin(ANNEX))


def windows(pages: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """doc, start, pages: each document's distinct pages in windows of ``size`` every ``step``; one window if they fit in one."""
    lists = pages.groupBy("doc").agg(F.array_sort(F.collect_set("page")).alias("all"))
    return lists.select("doc", "all", F.explode(_starts("all", size, step)).alias("start")).select("doc", "start", F.slice("all", F.col("start") + 1, F.lit(size)).alias("pages"))


def _starts(pages: str, size: int, step: int) -> Column:
    return F.when(F.size(pages) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(pages) - 2, F.lit(step)))


def runs(pages: DataFrame) -> DataFrame:
    """doc, first_page, last_page, n: maximal runs of consecutive pages."""
    rows = pages.select("doc", "page").distinct()
    island = F.col("page") - F.row_number().over(W.partitionBy("doc").orderBy("page"))
    return rows.withColumn("island", island).groupBy("doc", "island").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n")).drop("island")


def rule_section(pages: DataFrame) -> DataFrame:
    """doc, page: pages with rules, those that run on into them, and the one that each of them runs on into.

    ``pages`` has (doc, page, labels, continues), one row a page.  A page can belong to the
    section if it has rules or none of the labels that end one.
    """
    own, after = W.partitionBy("doc").orderBy("page"), W.partitionBy("doc").orderBy("page").rowsBetween(0, W.unboundedFollowing)
    rules = has("rules")
    rows = pages.select("doc", "page", "continues", rules.alias("rules"), (rules | ~has(*BLOCKERS)).alias("open"))
    rows = rows.withColumn("runs_on", F.col("continues") & F.col("open") & F.coalesce(F.lead("page").over(own) == F.col("page") + 1, F.lit(False)))
    rows = rows.withColumn("end", F.min(F.when(~F.col("runs_on"), F.col("page"))).over(after))
    rows = rows.withColumn("next_rules", F.min(F.when(F.col("rules"), F.col("page"))).over(after.rowsBetween(1, W.unboundedFollowing)))
    before = F.lag(F.struct("page", "continues", "rules")).over(own)
    rows = rows.withColumn("follows", F.coalesce((before["page"] == F.col("page") - 1) & before["continues"] & before["rules"] & F.col("open"), F.lit(False)))
    return rows.filter(F.col("rules") | F.col("follows") | (F.col("runs_on") & (F.col("next_rules") <= F.col("end")))).select("doc", "page")


def annex_runs(pages: DataFrame) -> DataFrame:
    """doc, first_page, pages: runs of consecutive pages that have the same annex labels."""
    own = W.partitionBy("doc").orderBy("page")
    marked = pages.select("doc", "page", F.array_sort(F.array_intersect("labels", F.array(*map(F.lit, ANNEX)))).alias("marks"))
    before = F.lag(F.struct("page", "marks")).over(own)
    same = F.coalesce((before["page"] == F.col("page") - 1) & (before["marks"] == F.col("marks")), F.lit(False))
    rows = marked.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(own.rowsBetween(W.unboundedPreceding, 0))).filter(F.size("marks") > 0)
    return rows.groupBy("doc", "run").agg(F.array_sort(F.collect_list("page")).alias("pages")).select("doc", F.col("pages")[0].alias("first_page"), "pages")


def chunks(pages: DataFrame) -> DataFrame:
    """doc, agent, chunk_id, pages, focus, section (arrays), supporting: what each reader is asked about; unknown pages go to review as well.

    Only arrays of one document's pages are gathered.
    """
    lists = lambda keep: F.array_sort(F.collect_set(F.when(keep, F.col("page"))))
    by_doc = pages.groupBy("doc").agg(lists(has("appointments")).alias("named"), lists(has("appointments", *RIDE_ALONG)).alias("around"), lists(has("specimens")).alias("signed"), lists(has("other_unknown")).alias("unknown"))
    appointed = by_doc.filter(F.size("around") > 0).select("doc", F.lit(0).alias("rank"), F.col("around").alias("pages"), F.col("around").alias("focus"), F.when(F.size("named") > 0, F.col("named")).otherwise(F.col("around")).alias("section"))
    section = runs(rule_section(pages)).select("doc", F.sequence("first_page", "last_page").alias("section"))
    ruled = section.withColumn("start", F.explode(_starts("section", SIZE, STEP))).withColumn("pages", F.slice("section", F.col("start") + 1, F.lit(SIZE)))
    last = (F.size("section") <= SIZE) | (F.col("start") + STEP >= F.size("section") - 1)
    ruled = ruled.select("doc", F.lit(1).alias("rank"), "pages", F.when(last, F.col("pages")).otherwise(F.slice("pages", F.lit(1), F.size("pages") - 1)).alias("focus"), "section")
    signed = by_doc.select("doc", F.lit(2).alias("rank"), F.explode("signed").alias("page"), "signed").select("doc", "rank", F.array("page").alias("pages"), F.array("page").alias("focus"), F.col("signed").alias("section"))
    annexed = annex_runs(pages).select("doc", F.lit(3).alias("rank"), "pages", F.col("pages").alias("focus"), F.col("pages").alias("section"))
    unknown = by_doc.select("doc", F.lit(4).alias("rank"), F.explode("unknown").alias("page")).select("doc", "rank", *(F.array("page").alias(c) for c in ("pages", "focus", "section")))
    every = reduce(DataFrame.union, (appointed, ruled, signed, annexed, unknown))
    agent = F.array(*map(F.lit, AGENTS))[F.col("rank")]
    return every.select("doc", agent.alias("agent"), F.concat(agent, F.lit("_p"), T.page_list(F.col("pages"), "+")).alias("chunk_id"), "pages", "focus", "section", (F.col("rank") >= 3).alias("supporting"))


def headers(planned: DataFrame, documents: DataFrame) -> DataFrame:
    """``planned`` chunks with ``header``; ``documents`` has (doc, company, hints).  Fixed values: its wording."""
    rest = F.array_except("pages", "focus")
    hints = F.array_join(F.filter(F.transform("hints", lambda h: F.regexp_replace(F.trim(h), "[.;]+$", "")), lambda h: h != ""), "; ")
    own = F.when((F.col("agent") == "rules") & (F.size(rest) > 0), F.concat(F.lit(" Emit only clauses whose first quoted words begin on pages "), T.page_list(F.col("focus")), F.lit("; pages "), T.page_list(rest), F.lit(" are continuation context only."))).otherwise("")
    parts = (
        F.lit("Document: imza sirküleri of "), F.coalesce("company", F.lit("UNREADABLE")), F.lit(". "), F.coalesce(F.nullif(hints, F.lit("")), F.lit("No structure hints")), F.lit(". This request covers pages "),
        T.page_list(F.col("pages")), F.lit(" of the "), F.when(F.col("agent") == "review", "unclassified").otherwise(F.col("agent")), F.lit(" section spanning pages "), T.page_span(F.col("section")), F.lit("."), own, F.lit(" Page numbers below are absolute."),
    )
    return planned.join(documents, "doc", "left").select(*planned.columns, F.concat(*parts).alias("header"))


def page_differences(mapped: DataFrame, rendered: DataFrame) -> DataFrame:
    """doc, missing, extra: pages of the map that weren't rendered, and rendered ones that it doesn't have; documents without any are left out."""
    both = mapped.select("doc", "page", F.lit(True).alias("m")).join(rendered.select("doc", "page", F.lit(True).alias("r")), ["doc", "page"], "full")
    lists = lambda c: F.array_sort(F.collect_set(F.when(F.col(c).isNull(), F.col("page"))))
    return both.groupBy("doc").agg(lists("r").alias("missing"), lists("m").alias("extra")).filter((F.size("missing") > 0) | (F.size("extra") > 0))
