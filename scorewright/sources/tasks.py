"""Task bank, task inputs and their assembly into one text per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright import schemas
from scorewright.operators.packing import PART_BYTES, pack
from scorewright.scale import fits_broadcast, lookup_join, materialize

# Mark of a skipped task, line above each input file, gap between two of them.
SKIP_MARK = "[SKIPPED]"
FILE_LINE = ("=== FILE: ", " ===\n")
BLOCK_GAP = "\n\n"


def labelled(name: Column, text: Column) -> Column:
    """A text under the line that names it."""
    return F.concat(F.lit(FILE_LINE[0]), name, F.lit(FILE_LINE[1]), text)


def read_tasks(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Task bank with the fixed schema; fields missing from the files come back as NULL."""
    return spark.read.schema(schemas.TASK).format(file_format).load(path)


def profile_tasks(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Number of tasks per group."""
    return tasks.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tasks"))


def concat_labelled(
    pieces: DataFrame,
    group: str,
    position: str,
    label: str,
    text: str,
    *,
    max_bytes: int = PART_BYTES,
) -> DataFrame:
    """Join the pieces of each group in order, each under a line that names it.

    A group of more than ``max_bytes`` comes out as several rows, to be read by rising ``part`` (see
    :func:`packing.pack`), so that no row has to hold a group without bound; nothing is left out, and a
    piece longer than that has a row of its own.
    """
    block = labelled(F.col(label), F.col(text))
    blocks = pieces.select(group, position, block.alias("_block")).withColumn(
        "_bytes", F.octet_length("_block") + F.lit(len(BLOCK_GAP.encode()))
    )
    parts = pack(blocks, [group], [position], "_bytes", max_bytes=max_bytes)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.col("_block").alias("block"))))
    return parts.groupBy(group, "part").agg(
        F.count(F.lit(1)).alias("n_pieces"),
        F.array_join(F.transform(ordered, lambda piece: piece["block"]), BLOCK_GAP).alias("text"),
    )


def resolve_inputs(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Give each task its input text; one missing file leaves the whole task without input.

    ``files`` has one row per ``ref`` with its ``text`` (NULL when it could not be read) and
    ``n_bytes``. Inline tasks keep ``inline_input``. ``input_bytes`` is the UTF-8 size of the text,
    for images that of the file. ``input_found`` is false for tasks to be skipped, whose
    ``missing_ref`` names the first file that is absent.

    References are stored first: while the files they name fit a broadcast, the texts of all others stay
    where they are.
    """
    wanted = materialize(tasks.select("task_id", F.posexplode("input_refs").alias("pos", "ref")), "wanted")
    held = files.select("ref", "text", "n_bytes")
    named = materialize(wanted.select("ref").distinct(), "named")
    if fits_broadcast(named):
        held = held.join(F.broadcast(named), "ref", "left_semi")
    found = lookup_join(wanted, held, ["ref"], spread=["task_id", "pos"], may_broadcast=False)
    per_task = found.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_refs"),
        F.count("text").alias("n_found"),
        F.min_by("ref", F.when(F.col("text").isNull(), F.col("pos"))).alias("missing_ref"),
        F.sum("n_bytes").alias("file_bytes"),
        F.array_sort(F.collect_list(F.struct("pos", "ref", "text"))).alias("pieces"),
    )
    combined = F.array_join(F.transform("pieces", lambda p: labelled(p["ref"], p["text"])), BLOCK_GAP)
    is_multi = F.col("input_type") == "multi"
    text = F.when(F.coalesce(F.size("input_refs"), F.lit(0)) <= 0, F.col("inline_input")).when(
        F.col("n_found") == F.col("n_refs"),
        F.when(is_multi, combined).otherwise(F.get("pieces", 0)["text"]),
    )
    joined = tasks.join(per_task, "task_id", "left")
    has_refs = F.coalesce(F.size("input_refs"), F.lit(0)) > 0
    complete = ~has_refs | (F.col("n_found") == F.col("n_refs"))
    return joined.select(
        *tasks.columns,
        text.alias("input_text"),
        F.when(F.col("input_type") == "image", F.col("file_bytes"))
        .otherwise(F.octet_length(text))
        .cast("bigint")
        .alias("input_bytes"),
        F.coalesce(complete, F.lit(False)).alias("input_found"),
        F.when(has_refs, F.col("missing_ref")).alias("missing_ref"),
    )


def mark_skipped(tasks: DataFrame, found: str, output: str) -> DataFrame:
    """Tasks without input keep their row: ``skipped`` true, a marker as output, success NULL if there is one.

    Whether the others succeed is left to scoring. A NULL in ``found`` counts as not found.
    """
    has = F.coalesce(F.col(found), F.lit(False))
    marked = {
        "skipped": ~has,
        output: F.when(has, F.col(output)).otherwise(F.lit(SKIP_MARK + " missing input")),
    }
    if "success" in tasks.columns:
        marked["success"] = F.when(has, F.col("success"))
    return tasks.withColumns(marked)


def pair_turns(conversations: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows directly, NULL where there is none.

    An equi join on (conversation, turn) rather than a window over the conversation, so a very long
    conversation is spread like any other rows.
    """
    asked = conversations.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    replies = conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return asked.join(replies, ["conv_id", "turn"], "left")
