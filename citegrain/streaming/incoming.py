"""New entries as a stream against a catalogue table: an extension, by the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.functions.text import doi


def match_by_doi(stream: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Stream-static join of new entries (ID, doi) with the catalogue's rows of their DOI; entries without one go on unmatched."""
    return stream.withColumn("e_doi", doi(F.col("doi"))).join(catalogue, F.col("e_doi") == F.col("c_doi"), "left")


def first_seen(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Each (title, author) once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["title", "author"])
