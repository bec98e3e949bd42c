"""Answers for prompts: recorded ones, or from a model function the caller brings."""

from __future__ import annotations

import ast
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright import schemas
from scorewright.functions import text as T
from scorewright.scale import bounded_batches, lookup_join, materialize

ModelCall = Callable[[str, str], tuple[str, int]]

#: Bytes of code that a task of the syntax check holds at once.
CODE_BYTES = 2 * 1024 * 1024


def one_per_key(responses: DataFrame, keys: Iterable[str]) -> DataFrame:
    """One response per key: one without error first, then by output, tokens, latency and error text."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(F.col("error").isNotNull(), "output", "tokens", "latency_s", "error")
    return responses.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def replay(
    prompts: DataFrame, responses: DataFrame, *, spread: list[str], keys: tuple[str, ...] = ("prompt_sha",)
) -> DataFrame:
    """Attach recorded responses by their ``keys``; a prompt without one gets empty output.

    The same prompt may stand behind any share of the rows, so the join spreads hot keys.
    """
    unique = one_per_key(responses, keys).select(*keys, "output", "tokens", "latency_s", "error")
    joined = lookup_join(prompts, unique, keys, spread=spread, may_broadcast=False)
    missing = F.col("output").isNull()
    return joined.withColumns(
        {
            "output": F.coalesce("output", F.lit("")),
            "tokens": F.coalesce("tokens", F.lit(0).cast("bigint")),
            "latency_s": F.coalesce("latency_s", F.lit(0.0)),
            "error": F.when(missing & F.col("error").isNull(), F.lit("no recorded response")).otherwise(F.col("error")),
        }
    )


def call_model(
    prompts: DataFrame, model_call: ModelCall, path: str, *, parallel_calls: int, rounds: int = 1
) -> DataFrame:
    """Answer each distinct prompt that ``path`` does not hold yet, and return the stored responses.

    ``model_call(prompt, model)`` returns (output, tokens). A call that raises yields empty output
    and the error text. Responses are written, keyed by prompt and model, before anyone reads them:
    a second run calls only for what is missing or has failed so far. ``parallel_calls`` tasks call
    at the same time.

    Prompts are dealt into ``rounds`` buckets by a hash of their key, and each bucket's answers are
    committed before the next one begins. A run that is killed repeats the calls of one bucket at
    most; buckets whose prompts are all answered are not begun again.
    """
    spark = prompts.sparkSession
    keys = ["prompt_sha", "model"]
    distinct = prompts.select(*keys, "prompt").dropDuplicates(keys)
    try:
        known = spark.read.schema(schemas.RESPONSE).parquet(path)
        distinct = distinct.join(known.where("error IS NULL").select(*keys), keys, "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise

    def answer(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sha, model, prompt in zip(batch["prompt_sha"], batch["model"], batch["prompt"]):
                began = time.monotonic()
                try:
                    output, tokens = model_call(prompt, model)
                    failed = None
                except Exception as error:
                    output, tokens, failed = "", 0, str(error)
                rows.append((sha, model, output, tokens, round(time.monotonic() - began, 2), failed))
            yield pd.DataFrame(
                rows, columns=["prompt_sha", "model", "output", "tokens", "latency_s", "error"]
            )

    dealt = distinct.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(rounds)))
    todo = materialize(dealt, "prompts", by=["bucket"])
    buckets = sorted(row["bucket"] for row in todo.select("bucket").distinct().collect())  # at most ``rounds``
    for bucket in buckets:
        asked = todo.where(F.col("bucket") == bucket).drop("bucket")
        answered = asked.repartition(parallel_calls, "prompt_sha").mapInPandas(answer, schemas.RESPONSE)
        answered.write.mode("append").parquet(path)
    if not buckets:
        spark.createDataFrame([], schemas.RESPONSE).write.mode("append").parquet(path)
    return one_per_key(spark.read.schema(schemas.RESPONSE).parquet(path), keys)


def _syntax_verdict(code: str | None) -> tuple[bool, str]:
    try:
        body = ast.parse(code or "").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return False, f"parse failed: {error}"
    for node in body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.ImportFrom)):
            return True, "parsed, defines a callable"
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Lambda):
            return True, "parsed, defines a callable"
    return False, "parsed, no callable"


def code_gate(answers: DataFrame, id_column: str, code: str) -> DataFrame:
    """Does the code parse and define something callable? Adds ``passed`` and ``method``.

    The code is parsed, never run: unlike a check by execution, it does not see run-time errors.
    """
    schema = f"{id_column} {answers.schema[id_column].dataType.simpleString()}, passed BOOLEAN, method STRING"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time is a Python string; the batch stays as it came.
            verdicts = [_syntax_verdict(code_text.as_py()) for code_text in batch.column(1)]
            passed = pa.array([passed for passed, _ in verdicts], pa.bool_())
            method = pa.array([method for _, method in verdicts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), passed, method], [id_column, "passed", "method"])

    bounded_batches(answers.sparkSession, CODE_BYTES)
    return answers.select(id_column, code).mapInArrow(check, schema)


def parse_items(answers: DataFrame, raw: str, item_schema: str = schemas.PLAN_ITEM) -> DataFrame:
    """Add ``items``, the JSON array in the answer, and ``valid``; what does not parse is empty.

    A code fence around the array is dropped first. Valid is only an array that takes the whole text
    and whose values have the types of ``item_schema``. The text is parsed as a field of an object and
    as an element of an array: what follows the array breaks the one or the other.
    """
    text = T.first_code_block(F.col(raw))
    corrupt = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    field = F.from_json(F.concat(F.lit('{"items": '), text, F.lit("}")), f"items {item_schema}, _corrupt STRING", corrupt)
    element = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "ARRAY<STRING>")
    valid = field["items"].isNotNull() & field["_corrupt"].isNull() & (F.size(element) == 1)
    return answers.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn(
        "items", F.when(F.col("valid"), field["items"]).otherwise(F.array())
    )
