"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, forest, html, infill, licenses, mixing, quality, simhash, suffix_tree, syncmers, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_forest": forest.op1_forest,
        "op2_suffix_tree": suffix_tree.op2_suffix_tree,
        "op3_quality": quality.op3_quality,
        "op4_warc": warc.op4_warc,
        "op5_html": html.op5_html,
        "op6_licenses": licenses.op6_licenses,
        "op7_simhash": simhash.op7_simhash,
        "op8_mixing": mixing.op8_mixing,
        "op9_syncmers": syncmers.op9_syncmers,
        "op10_bpe": bpe.op10_bpe,
        "op11_audit": audit.op11_audit,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_infill": infill.op13_infill,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_licenses": licenses.SQL, "op8_mixing": mixing.SQL, "op11_audit": audit.SQL, "op13_infill": infill.SQL}
