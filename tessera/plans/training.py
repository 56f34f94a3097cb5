"""Data side of fine-tuning: verified files to prompts and completions. The trainer is not part of this engine."""

from __future__ import annotations

import json
import platform
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.checks import require_valid_messages
from ..operators.export import prompt_completion, verify_files
from ..operators.sampling import seeded_subset
from ..sources.config import experiment_name, flatten
from ..sources.files import read_jsonl, require


def training_data(spark: SparkSession, directory: str, selection: str, limit: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Prompts and completions of the training and the selection set, after checking both against the manifest.

    One invalid training row fails the whole set; invalid selection rows are left out.
    """
    manifest = json.loads("\n".join(r.value for r in spark.read.text(require(spark, f"{directory}/dataset_manifest.json")).collect()))
    files = ["training.jsonl", f"{selection}.jsonl"]
    verify_files(spark, {f"{directory}/{f}": manifest[f]["sha256"] for f in files})
    train, chosen = (read_jsonl(spark, f"{directory}/{f}", schemas.BENCHMARK_LINE, optional=False) for f in files)
    train = require_valid_messages(train)
    if limit:
        train = seeded_subset(train.withColumn("_key", F.to_json("messages")), limit, seed, "_key").drop("_key")
    return prompt_completion(train), prompt_completion(chosen)


class RunLog:
    """Tracking of a run: parameters, tags, metrics and status as rows of a table; no server."""

    SCHEMA = "run string, experiment string, kind string, name string, value string, step long"

    def __init__(self, spark: SparkSession, path: str, config: dict[str, Any], run_type: str = "training"):
        self.spark, self.path, self.config = spark, path, config
        self.run, self.experiment = f"{run_type}-{config['run_name']}", experiment_name(config, run_type)

    def start(self) -> None:
        self._add([("param", k, str(v), 0) for k, v in flatten(self.config).items()])
        self._add([("tag", "base_model", str(self.config["base_model"]), 0), ("tag", "dataset_version", str(self.config["dataset_version"]), 0), ("tag", "python_version", platform.python_version(), 0), ("status", "status", "running", 0)])

    def metrics(self, values: dict[str, Any], step: int = 0) -> None:
        """Numbers only; anything else is left out."""
        self._add([("metric", k, repr(float(v)), step) for k, v in values.items() if isinstance(v, (int, float)) and not isinstance(v, bool)])

    def finish(self, **artifacts: str) -> None:
        self._add([("artifact", k, v, 0) for k, v in artifacts.items()] + [("status", "status", "finished", 1)])

    def fail(self, error: Exception) -> None:
        self._add([("tag", "error", str(error)[:500], 0), ("status", "status", "failed", 1)])

    def _add(self, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame([(self.run, self.experiment, *r) for r in rows], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
