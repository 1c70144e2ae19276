"""An inverted index of claims' character runs, kept as a table and extended by what is new.

The table holds (gram, project, id), in ``slots`` folders by the gram's hash and sorted
by gram within a file, so that a search reads the folders of its own grams only and
skips most of each. Claims are appended once; whether they are archived, and what their
text is now, is asked when the index is read. A claim whose text was revised is appended
again: its old grams only bring it up for the check of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N = 4


def grams(text: Column) -> Column:
    """The distinct runs of ``N`` characters of a text."""
    every = F.transform(F.sequence(F.lit(1), F.char_length(text) - (N - 1)), lambda i: F.substring(text, i, F.lit(N)))
    return F.when(F.char_length(text) >= N, F.array_distinct(every))


class GramIndex:
    """The index at a place of the shared file system."""

    def __init__(self, spark: SparkSession, path: str, slots: int = 64):
        self.spark, self.path, self.slots = spark, path, slots

    def _slot(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.slots)).cast("int")

    def append(self, claims: DataFrame) -> None:
        """Adds claims (id, project, text); null texts and those of fewer than ``N`` characters have no grams."""
        rows = claims.select(F.explode(grams(F.lower("text"))).alias("gram"), "project", "id").withColumn("slot", self._slot(F.col("gram")))
        rows.repartition("slot", F.pmod(F.xxhash64("gram", "id"), F.lit(8))).sortWithinPartitions("slot", "gram").write.mode("append").partitionBy("slot").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema("gram string, project string, id string, slot int").parquet(self.path)

    def candidates(self, text: str, project: str | None = None) -> DataFrame:
        """``(id)`` of claims that have had all grams of ``text``, which has ``N`` characters or more."""
        low = text.lower()
        of = sorted({low[i : i + N] for i in range(len(low) - N + 1)})
        slots = [r[0] for r in self.spark.createDataFrame([(g,) for g in of], "gram string").select(self._slot(F.col("gram"))).distinct().collect()]
        rows = self.rows().where(F.col("slot").isin(slots) & F.col("gram").isin(of))
        rows = rows if project is None else rows.where(F.col("project") == project)
        return rows.groupBy("id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(of)).select("id")

    def search(self, claims: DataFrame, text: str, project: str | None = None, basis: str | None = None) -> DataFrame:
        """Active claims whose text holds ``text`` in any case, as ``search_claims`` finds them; a shorter text than ``N`` scans the claims."""
        rows = claims.where(~F.coalesce("archived", F.lit(False)) & F.contains(F.lower("text"), F.lower(F.lit(text))))
        rows = rows if project is None else rows.where(F.col("project") == project)
        rows = rows if basis is None else rows.where(F.col("basis") == basis)
        return rows if len(text) < N else rows.join(self.candidates(text, project), "id", "left_semi").select(*claims.columns)

    def spread(self, active: DataFrame) -> DataFrame:
        """``(project, id, low, gram)`` of active claims (id, project, low), from the index; grams that a text has no more are left out."""
        rows = self.rows().select("id", "gram").distinct().join(active.select("id", "project", "low"), "id")
        return rows.where(F.contains("low", "gram")).select("project", "id", "low", "gram")
