"""Contexts of neighbouring chunks, and of whole pages or windows of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .. import formats
from ..functions.text import heading_label, render_chunk, tokens_of_length
from .corpus import PAGE

JOINT = len(formats.CHUNK_JOINT)


def page_id(strategy: str = formats.PAGE_STRATEGY) -> Column:
    return F.concat_ws(":", *PAGE, F.lit(strategy))


def adjacent_contexts(rows: DataFrame, max_chars: int = formats.ADJACENT_CHARS) -> DataFrame:
    """For each chunk a context with the previous and the next eligible chunk of its page, as far as the budget goes."""
    near = Window.partitionBy(*PAGE).orderBy("position", "chunk_id")
    chunk = F.struct("chunk_id", "heading_path", "chunk_text")
    rows = rows.withColumn("before", F.lag(chunk).over(near)).withColumn("after", F.lead(chunk).over(near))
    size = lambda c: F.length(F.col(f"{c}.chunk_text")) + JOINT
    takes_before = F.col("before").isNotNull() & (F.length("chunk_text") + size("before") <= max_chars)
    rows = rows.withColumn("_before", F.when(takes_before, F.col("before")))
    used = F.length("chunk_text") + F.coalesce(size("_before"), F.lit(0))
    rows = rows.withColumn("_after", F.when(F.col("after").isNotNull() & (used + size("after") <= max_chars), F.col("after")))
    chosen = F.filter(F.array("_before", chunk, "_after"), lambda x: x.isNotNull())
    rows = rows.withColumn("_chosen", chosen)
    return rows.select(
        F.concat_ws(":", *PAGE, "chunk_id").alias("context_id"), *PAGE, "category", F.col("_chosen.chunk_id").alias("chunk_ids"), "source_url", "source_title",
        F.col("_chosen.heading_path").alias("heading_paths"), F.array_join("_chosen.chunk_text", formats.CHUNK_JOINT).alias("context"),
    )


def sections(rows: DataFrame, label: str = "label") -> DataFrame:
    """Numbers runs of equal labels within a page, from 1; a label that comes again begins another section."""
    order = Window.partitionBy(*PAGE).orderBy("position", "chunk_id")
    return rows.withColumn("_new", F.when(F.col(label).eqNullSafe(F.lag(label).over(order)) & (F.row_number().over(order) > 1), 0).otherwise(1)).withColumn("section", F.sum("_new").over(order)).drop("_new")


class OversizedChunk(ValueError):
    """A chunk exceeds the budget by itself."""


class Packer:
    """Greedy packing of sections in reading order under a budget of characters; `out` has what is settled.

    A window opens at a section that no longer fits, and inside a section that
    is oversized by itself at a chunk that no longer fits; a page within the
    budget is window 0. Rows wait only until their page or section ends or has
    more characters than the budget, so a page may be of any length.
    """

    def __init__(self, budget: float):
        self.budget, self.page, self.out = budget, None, []

    def add(self, page: tuple, key: bytes, nth: int, chunk: str, label: str, title: int, chars: int) -> None:
        if page != self.page:
            self.finish()
            self.page, self.rows, self.page_chars, self.waiting, self.large = page, 0, title - JOINT, [], False
            self.section, self.window, self.used, self.title = None, 0, 0, 0
        row = (key, nth, chunk, label, title, chars)
        self.rows += 1
        if self.large:
            return self.take(row)
        self.page_chars += JOINT + chars
        self.waiting.append(row)
        if self.page_chars > self.budget:
            self.large, rows, self.waiting = True, self.waiting, []
            for row in rows:
                self.take(row)

    def take(self, row: tuple) -> None:
        label, chars = row[3], row[5]
        if self.section is None or label != self.section[0]:
            self.settle()
            self.section, self.section_chars, self.settled = (label,), chars, False
            self.waiting.append(row)
        elif self.settled:
            self.place(row, False, chars)
        else:
            self.section_chars += JOINT + chars
            self.waiting.append(row)
        if not self.settled and self.section_chars > self.budget:
            self.settle()

    def settle(self) -> None:
        """The section's characters are known, or known to be more than the budget, which is the same for all that follows."""
        rows, self.waiting, self.settled = self.waiting, [], True
        if rows:
            self.oversized = rows[0][4] + self.section_chars > self.budget
        for k, row in enumerate(rows):
            self.place(row, not k, row[5] if k else self.section_chars)

    def place(self, row: tuple, starts: bool, grows: int) -> None:
        key, nth, chunk, _, title, chars = row
        if self.oversized and title + chars > self.budget:
            raise OversizedChunk(f"chunk {chunk} exceeds the budget of a window by itself")
        if not self.window or (starts or self.oversized) and self.title + self.used + JOINT + grows > self.budget:
            self.window, self.used, self.title = self.window + 1, chars, title
        else:
            self.used += JOINT + chars
        self.out.append((key, nth, self.window, *self.page, None))

    def finish(self) -> None:
        """Ends a page: one more row has its number of rows."""
        if self.page is None:
            return
        if self.large:
            self.settle()
        else:
            self.out += [(key, nth, 0, *self.page, None) for key, nth, *_ in self.waiting]
        self.out.append((None, None, None, *self.page, self.rows))


def number_windows(sizes: DataFrame, budget: float) -> DataFrame:
    """(_key, _nth, window, page_chunk_count) of rows of sizes: windows of Packer, rows of the page.

    Rows have no text, and stream by in page order.
    """
    names = ("_key", "_nth", "chunk_id", "label", "title_chars", "chunk_chars")
    kinds = [sizes.schema[c] for c in PAGE]
    schema = StructType([StructField("_key", BinaryType()), StructField("_nth", IntegerType()), StructField("window", IntegerType()), *kinds, StructField("_rows", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(budget)

        def settled() -> Iterator[pa.RecordBatch]:
            rows, packer.out = packer.out, []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema.names)

        types = [pa.binary(), pa.int32(), pa.int32(), None, None, pa.int32()]
        for batch in batches:
            types[3:5] = [batch.column(c).type for c in PAGE]
            for doc, version, *row in zip(*(batch.column(c).to_pylist() for c in (*PAGE, *names))):
                packer.add((doc, version), *row)
            yield from settled()
        packer.finish()
        yield from settled()

    numbered = sizes.repartition(*PAGE).sortWithinPartitions(*PAGE, "position", "chunk_id", "label").mapInArrow(run, schema)
    counts = numbered.where(F.col("_rows").isNotNull()).select(*(F.col(c).alias(f"_{c}") for c in PAGE), F.col("_rows").alias("page_chunk_count"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PAGE]
    return numbered.where(F.col("_rows").isNull()).join(counts, same).select("_key", "_nth", "window", "page_chunk_count")


def page_contexts(rows: DataFrame, max_input_tokens: int = formats.PAGE_TOKENS, chars_per_token: float = formats.CHARS_PER_TOKEN) -> DataFrame:
    """One context for a page within the budget, consecutive windows for a larger one."""
    if max_input_tokens <= 0:
        raise ValueError("max_input_tokens must be positive")
    if chars_per_token <= 0:
        raise ValueError("chars_per_token must be positive")
    budget = max_input_tokens * chars_per_token
    rows = rows.withColumn("label", heading_label(F.col("heading_path"))).withColumn("rendered", render_chunk(F.col("label"), F.col("chunk_text")))
    title = F.concat(F.lit(formats.PAGE_HEADER), F.coalesce("source_title", F.lit("None")), F.lit(formats.CHUNK_JOINT))
    rows = rows.withColumn("title", title).withColumn("title_chars", F.length("title")).withColumn("chunk_chars", F.length("rendered"))
    # Rows of one key are alike in all that windows depend on, so it doesn't matter which of them is the nth. Texts only meet their window's number by it;
    # no task has to hold a page's texts.
    sizes = [*PAGE, "position", "chunk_id", "label", "title_chars", "chunk_chars"]
    rows = rows.withColumn("_key", F.unhex(F.md5(F.to_json(F.struct(sizes), {"ignoreNullFields": "false"}))))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("_key")))
    numbers = number_windows(rows.select("_key", "_nth", *sizes), budget)
    lost = F.raise_error(F.lit("a chunk has no window: its input changed between two readings")).cast("int")
    windows = rows.join(numbers, ["_key", "_nth"], "left").withColumn("window", F.coalesce("window", lost))
    chunk = F.struct("position", "chunk_id", "label", "rendered", "title", "category", "source_url", "source_title")
    grouped = windows.groupBy(*PAGE, "window").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"), F.first("page_chunk_count").alias("page_chunk_count"))
    grouped = grouped.withColumn("context", F.concat(F.col("chunks")[0]["title"], F.array_join("chunks.rendered", formats.CHUNK_JOINT)))
    suffix = F.when(F.col("window") > 0, F.format_string(":window-%03d", "window")).otherwise("")
    first = F.col("chunks")[0]
    return grouped.select(
        F.concat(page_id(), suffix).alias("context_id"), F.lit(formats.PAGE_STRATEGY).alias("generation_strategy"),
        F.when(F.col("window") > 0, formats.PAGE_WINDOW).otherwise(formats.WHOLE_PAGE).alias("context_kind"), F.greatest("window", F.lit(1)).alias("window_index"), *PAGE,
        first["category"].alias("category"), first["source_url"].alias("source_url"), first["source_title"].alias("source_title"), "page_chunk_count",
        F.col("chunks.chunk_id").alias("chunk_ids"), F.col("chunks.label").alias("heading_paths"), tokens_of_length(F.length("context"), chars_per_token).alias("estimated_context_tokens"), "context",
    )


def context_summary(contexts: DataFrame) -> DataFrame:
    """Whole pages, windows, pages with windows, and the largest estimate (null without contexts)."""
    window = F.col("context_kind") == formats.PAGE_WINDOW
    return contexts.agg(F.count_if(~window).alias("full_pages"), F.count_if(window).alias("page_windows"), F.countDistinct(F.when(window, F.concat_ws(":", *PAGE))).alias("windowed_pages"), F.max("estimated_context_tokens").alias("largest_estimate"))
