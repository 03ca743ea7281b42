"""Saving fitted stages: parameters as JSON metadata, tables as Parquet."""

from __future__ import annotations

import json

from pyspark.ml import Model
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame


class FittedStage(Model, MLReadable, MLWritable):
    """A fitted stage made of a JSON-able ``state`` and named ``tables``."""

    def __init__(self, state: dict | None = None, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.state = state or {}
        self.tables = tables or {}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: FittedStage):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        stage = self.instance
        extra = {"state": json.loads(json.dumps(stage.state)), "tables": sorted(stage.tables)}
        DefaultParamsWriter.saveMetadata(stage, path, self.sparkSession, extraMetadata=extra)
        for name, table in stage.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FittedStage:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = {t: self.sparkSession.read.parquet(f"{path}/{t}") for t in meta["tables"]}
        stage = self.cls(meta["state"], tables)
        stage._resetUid(meta["uid"])
        return stage
