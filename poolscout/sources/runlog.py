"""Everything a run leaves behind, as Parquet tables below one folder.

``explored``, ``preds``, ``retained`` and ``state`` have one partition per iteration. A round overwrites its own
partition, so a repeated round leaves the same result.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What a round leaves besides its tables. One row per round; together they are the iteration table.
STATE = T.StructType(
    [
        T.StructField("next_iter", T.IntegerType()),
        T.StructField("adjustment", T.LongType()),
        T.StructField("exhausted", T.BooleanType()),
        T.StructField("generation", T.IntegerType()),
        T.StructField("recent_avgs", T.ArrayType(T.DoubleType())),
        T.StructField("n_scores", T.LongType()),
        T.StructField("n_new", T.LongType()),
        T.StructField("batch_mean", T.DoubleType()),
        T.StructField("top_k_avg", T.DoubleType()),
    ]
)


class RunLog:
    """Tables of one run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._schemas: dict[str, T.StructType] = {}

    def _part(self, table: str, iteration: int) -> str:
        return f"{self.path}/{table}/iter={iteration}"

    def write(self, table: str, iteration: int, rows: DataFrame) -> DataFrame:
        """Write one iteration of a table and read it back, which also cuts its lineage."""
        rows.write.mode("overwrite").parquet(self._part(table, iteration))
        self._schemas[table] = rows.schema
        return self.spark.read.schema(rows.schema).parquet(self._part(table, iteration))

    def read(self, table: str, last: int | None = None) -> DataFrame:
        """All iterations of a table, up to ``last``."""
        reader = self.spark.read.option("basePath", f"{self.path}/{table}")
        if table in self._schemas:
            reader = reader.schema(T.StructType([*self._schemas[table], T.StructField("iter", T.IntegerType())]))
        rows = reader.parquet(f"{self.path}/{table}")
        return rows if last is None else rows.filter(F.col("iter") <= last)

    def predictions(self, iteration: int, iterations: int) -> DataFrame:
        """Predictions made for a round. The initial round is drawn without any."""
        if not 1 <= iteration < iterations:
            raise IndexError(f"there are predictions for iterations 1 to {iterations - 1}, not {iteration}")
        return self.read("preds").filter(F.col("iter") == iteration)

    def write_config(self, run_id: str, params: Mapping[str, Any]) -> None:
        """Options as text; those that are None or False are left out."""
        kept = {k: json.dumps(v) if isinstance(v, (list, tuple)) else str(v) for k, v in params.items() if v not in (None, False)}
        schema = T.StructType(
            [T.StructField("run_id", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType()))]
        )
        self.spark.createDataFrame([(run_id, kept)], schema).coalesce(1).write.mode("overwrite").json(f"{self.path}/config")

    def read_config(self) -> DataFrame:
        """One row per option."""
        row = self.spark.read.schema("run_id STRING, params MAP<STRING, STRING>").json(f"{self.path}/config")
        return row.select("run_id", F.explode("params").alias("option", "value"))

    def write_state(self, state: Mapping[str, Any]) -> None:
        """Scalars of a run. A restart reads them together with the tables."""
        row = self.spark.createDataFrame([tuple(state[name] for name in STATE.fieldNames())], STATE)
        self.write("state", state["next_iter"] - 1, row.coalesce(1))

    def read_state(self) -> dict[str, Any]:
        """Scalars of the latest completed round."""
        return self.read("state").orderBy(F.col("iter").desc()).first().asDict()

    def write_final(self, explored: DataFrame) -> None:
        """All labels, best first, failures last; a range sort, so no task writes everything."""
        explored.orderBy(F.col("score").desc_nulls_last(), "id").write.mode("overwrite").parquet(f"{self.path}/final")


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder per split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)
