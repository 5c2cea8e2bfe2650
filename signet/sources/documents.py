"""Scanned documents: files as rows with their type, digest and why one isn't taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# How files of each type begin, as hexadecimal, their type and ending.
MAGIC = [("255044462D", "application/pdf", ".pdf"), ("89504E470D0A1A0A", "image/png", ".png"), ("FFD8FF", "image/jpeg", ".jpg")]
MOST_BYTES = 20 << 20


def ingest(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, name, mime, bytes, sha256, refused) for ``files`` (path, content), as ``binaryFile`` reads them.

    Pages aren't counted: that takes a renderer, which is out of scope.
    """
    head = F.hex(F.substring("content", 1, 8))
    pick = lambda k: F.coalesce(*(F.when(head.startswith(m[0]), F.lit(m[k])) for m in MAGIC))
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    refused = F.when(size == 0, "EMPTY").when(size > most_bytes, "TOO_LARGE").when(pick(1).isNull(), "UNSUPPORTED_TYPE")
    return files.select("path", T.display_name(F.col("path"), F.coalesce(pick(2), F.lit(""))).alias("name"), pick(1).alias("mime"), size.alias("bytes"), F.sha2("content", 256).alias("sha256"), refused.alias("refused"))
