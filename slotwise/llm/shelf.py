"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from slotwise.session import checkpoint_folder

FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Shelf:
    """Parquet tables that cut lineage: a lost executor costs at most the stage after the last table."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame, free: bool = False) -> DataFrame:
        """``df`` as a table; with ``free`` the shuffle files of its plan go as soon as it is written."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        before = self.spark.conf.get(FREE)
        try:
            if free:
                self.spark.conf.set(FREE, "true")
            df.write.parquet(path)
        finally:
            if free:
                self.spark.conf.set(FREE, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.shelf_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later plan reads."""
        for table in tables:
            self._remove(table.shelf_path)

    def clear(self) -> None:
        self._remove(self.folder)

    def _remove(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
