"""Helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.tables import BROADCAST_ROWS, cut, few, shared_folder

__all__ = ["BROADCAST_ROWS", "blank_words", "cut", "few", "light_batches", "lower_ascii", "remainder", "shared_folder"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "\t\n\x0b\x0c\r "
_BLANK_RUN = r"[\x20\x09-\x0D]+"

def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay. Pure ASCII text takes Spark's quick path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def blank_words(text: Column) -> Column:
    """Words between ASCII blanks; null and blank text give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK_RUN))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def light_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of at most `rows` rows: whole texts are long, and a batch stands in the memory of
    the executor and of its Python worker at once. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
