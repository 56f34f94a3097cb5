"""Calls to models and answer services from executors.

A client is any picklable function that takes a request (a dict) and returns a
reply (a dict); tests inject pure functions. Every row gives a reply or an
error, so that one failure loses nothing. Results are to be written before
anything reads them: a call that is made again may answer differently.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .. import formats

Client = Callable[[dict], dict]


def with_retries(client: Client, retries: int, wait_s: float = 1.0) -> Client:
    """Tries again after a wait that grows by wait_s each time."""

    def call(request: dict) -> dict:
        for attempt in range(retries):
            try:
                return client(request)
            except Exception:
                if attempt + 1 == retries:
                    raise
                time.sleep(wait_s * (attempt + 1))
        raise ValueError("retries must be positive")

    return call


def http_client(url: str, timeout_s: float = 180.0, headers: dict[str, str] | None = None) -> Client:
    """Posts the request as JSON and reads a JSON reply."""

    def call(request: dict) -> dict:
        posted = urllib.request.Request(url, json.dumps(request).encode(), {"Content-Type": "application/json", **(headers or {})})
        with urllib.request.urlopen(posted, timeout=timeout_s) as reply:
            return json.loads(reply.read())

    return call


def preflight(client: Client, request: dict) -> None:
    """Fails early if a service can't be reached."""
    try:
        client(request)
    except Exception as error:
        raise RuntimeError(f"the service doesn't answer: {error}") from error


def called(rows: DataFrame, client: Client, reply: str = "reply", workers: int = 6, retries: int = 1, wait_s: float = 1.0) -> DataFrame:
    """Adds `reply` (JSON text, null on failure), `error` (status text, null on success) and `latency_ms`.

    Each partition makes at most `workers` calls at a time.
    """
    schema = StructType([*rows.schema.fields, StructField(reply, StringType()), StructField("error", StringType()), StructField("latency_ms", LongType())])
    call = with_retries(client, retries, wait_s)

    def one(request: dict) -> tuple[str | None, str | None, int]:
        began = time.perf_counter()
        try:
            return json.dumps(call(request), ensure_ascii=False), None, round((time.perf_counter() - began) * 1000)
        except Exception as error:
            return None, formats.ERROR + str(error)[: formats.ERROR_CHARS], round((time.perf_counter() - began) * 1000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for batch in batches:
                done = list(pool.map(one, batch.to_dict("records")))
                batch[reply], batch["error"], batch["latency_ms"] = zip(*done) if done else ([], [], [])
                yield batch

    return rows.mapInPandas(run, schema)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successes and failures."""
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL")


def batched_answers(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], question: str = "question", batch: int = 4) -> DataFrame:
    """Answers by a local model: load() makes it once for each worker, which answers `batch` questions at a time.

    Adds answer and latency_ms, a batch's time shared evenly.
    """
    schema = StructType([*rows.schema.fields, StructField("answer", StringType()), StructField("latency_ms", LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in batches:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch].copy()
                began = time.perf_counter()
                part["answer"] = model(part[question].tolist())
                part["latency_ms"] = round((time.perf_counter() - began) * 1000 / len(part))
                yield part

    return rows.mapInPandas(run, schema)
