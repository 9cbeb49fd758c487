"""Named models of a session: DataFrames under names, as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PREFIX = "loomspark_model_"


class Models:
    """Adding under a name that is taken gives it a number: name-2, name-3 and so on."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    @staticmethod
    def _view(name: str) -> str:
        return PREFIX + name.encode().hex()

    def add(self, model: DataFrame, name: str = "model") -> str:
        free, n = name, 1
        while free in self.names:
            n += 1
            free = f"{name}-{n}"
        model.createOrReplaceTempView(self._view(free))
        self.names.append(free)
        return free

    def get(self, name: str = "") -> DataFrame:
        """An empty name is the first model."""
        if not self.names:
            raise KeyError("there is no model")
        name = name or self.names[0]
        if name not in self.names:
            raise KeyError(name)
        return self.spark.table(self._view(name))

    def delete(self, name: str) -> bool:
        if name not in self.names:
            return False
        self.names.remove(name)
        return self.spark.catalog.dropTempView(self._view(name))
