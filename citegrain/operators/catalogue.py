"""A catalogue kept for many runs: rows by place and by DOI, titles as an index. Joins with it move the entries, never the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrain.functions.text import normalise, text
from citegrain.operators.titles import TitleIndex
from citegrain.sources.tables import new_path, read_bucketed, stored, unsent, write_bucketed


def year_and_author(title: Column, year: Column, author: Column) -> Column:
    """A key of a title with a year and a first author, either of which may be null (any)."""
    part = lambda c: F.when(c.isNull(), "*").otherwise(F.concat(F.lit("="), c))
    return F.concat_ws("\t", title, part(year), part(author))


def first_of_doi(records: DataFrame) -> DataFrame:
    """The first row of each DOI. Rows without one are left where they are."""
    return records.where("c_doi IS NOT NULL").withColumn("rn", F.row_number().over(Window.partitionBy("c_doi").orderBy("c_pos"))).where("rn = 1").drop("rn")


def titled(records: DataFrame) -> DataFrame:
    """(c_pos, c_title, y, f) of the rows with a title: the normalised title, year and first author (missing ones: empty)."""
    return records.where(text(F.col("c_title")) != "").select("c_pos", normalise(F.col("c_title")).alias("c_title"), F.coalesce("c_year", F.lit("")).alias("y"), F.coalesce(normalise(F.get("c_authors", F.lit(0))), F.lit("")).alias("f"))


def first_of_title(records: DataFrame) -> DataFrame:
    """(key, f_pos): the first row of each title, of each title and year, of each title and author, and of all three."""
    any_ = F.lit(None).cast("string")
    each = F.explode(F.array(*(year_and_author(F.col("c_title"), y, f) for y in (F.col("y"), any_) for f in (F.col("f"), any_)))).alias("key")
    return titled(records).select("c_pos", each).groupBy("key").agg(F.min("c_pos").alias("f_pos"))


class Catalogue:
    """Flat catalogue rows (c_pos, c_doi, c_title, c_authors, c_journal, c_year, c_volume, c_issue, c_pages; c_pos tells them apart).

    `Catalogue.of` takes them as they are, for one run: only titles get an index. `Catalogue.build` writes all that lookups need to a folder, once, and
    `Catalogue.open` finds it again in any session. There rows are bucketed by what they are looked up by.
    """

    def __init__(self, rows: DataFrame, by_doi: DataFrame, by_title: DataFrame | None = None, titles: TitleIndex | None = None):
        self.rows, self.by_doi, self._by_title, self._titles = unsent(rows), unsent(by_doi), by_title, titles

    @property
    def by_title(self) -> DataFrame:
        if self._by_title is None:
            self._by_title = unsent(stored(first_of_title(self.rows), "firsts"))  # looked up twice
        return self._by_title

    @property
    def titles(self) -> TitleIndex:
        if self._titles is None:
            self._titles = TitleIndex.build(titled(self.rows))
        return self._titles

    @staticmethod
    def of(records: DataFrame | Catalogue) -> Catalogue:
        return records if isinstance(records, Catalogue) else Catalogue(records, first_of_doi(records))

    @staticmethod
    def build(records: DataFrame, path: str | None = None, buckets: int | None = None) -> Catalogue:
        """`buckets` (default: the session's shuffle partitions) should not be less than the shuffle partitions of the sessions that read it, or these may move it after all."""
        spark = records.sparkSession
        path, buckets = path or new_path(spark, "catalogue"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        write_bucketed(records, f"{path}/rows", "c_pos", buckets)
        write_bucketed(first_of_doi(records), f"{path}/dois", "c_doi", buckets)
        write_bucketed(first_of_title(records), f"{path}/firsts", "key", buckets)
        TitleIndex.build(titled(records), f"{path}/titles", buckets)
        return Catalogue.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Catalogue:
        titles = TitleIndex(spark, f"{path}/titles")
        rows, dois, firsts = (read_bucketed(spark, f"{path}/{name}", key, titles.buckets) for name, key in (("rows", "c_pos"), ("dois", "c_doi"), ("firsts", "key")))
        return Catalogue(rows, dois, firsts, titles)
