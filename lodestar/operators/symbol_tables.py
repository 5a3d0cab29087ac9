"""Symbol tables that are stored: names get vectors once, and every version can be read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.sources.tables import Ledger

SCHEMA = "space string, name string, vec array<double>, version int"


class SymbolTable:
    """``space, name, vec, version`` in a shared folder; ``version`` is the one a name came with.

    Reading changes nothing: a name that isn't held has no vector until it is registered.
    """

    def __init__(self, spark: SparkSession, folder: str, dimension: int) -> None:
        self.spark, self.ledger, self.dimension = spark, Ledger(spark, folder), dimension
        versions = self.ledger.versions()
        self.version = versions[-1] if versions else 0
        about = self.ledger.read(self.version) if versions else {"dimension": dimension}
        if about["dimension"] != dimension:
            raise ValueError(f"the table holds vectors of {about['dimension']} components")

    def _files(self, version: int) -> list[str]:
        return self.ledger.read(version)["files"]["symbols"] if version else []

    def load(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the last."""
        version = self.version if version is None else version
        if version and version not in self.ledger.versions():
            raise ValueError(f"no version {version}")
        files = self._files(version)
        return self.spark.read.schema(SCHEMA).parquet(*files) if files else self.spark.createDataFrame([], SCHEMA)

    def register(self, names: DataFrame, space: str) -> DataFrame:
        """Give names (the first column) that aren't held vectors, as a new version; the table after."""
        rows = names.select(F.col(names.columns[0]).cast("string").alias("name")).where("name is not null").distinct()
        known = self.load().where(F.col("space") == space).select("name")
        new = rows.join(known, "name", "left_anti")
        made = new.select(
            F.lit(space).alias("space"), "name", V.random_bipolar(F.lit(space), F.col("name"), self.dimension).alias("vec"),
            F.lit(self.version + 1).alias("version"),
        )
        files = self.ledger.part(made)
        if not self.spark.read.schema(SCHEMA).parquet(*files).isEmpty():
            self.ledger.commit(self.version + 1, {"files": {"symbols": self._files(self.version) + files}, "dimension": self.dimension})
            self.version += 1
        return self.load()

    def get(self, names: DataFrame, space: str) -> DataFrame:
        """``name, vec`` of names; null where a name isn't held."""
        rows = names.select(F.col(names.columns[0]).cast("string").alias("name")).distinct()
        return rows.join(self.load().where(F.col("space") == space).select("name", "vec"), "name", "left")
