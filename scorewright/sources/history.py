"""Run history: append one run's results, read runs of every layout back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright import schemas
from scorewright.sources import files

# Category labels of early runs and the labels that replaced them.
CATEGORY_LABELS = {
    "A-File/Log": "A - File/Log Analysis",
    "B-Code": "B - Code Generation",
    "C-Planning": "C - Planning",
    "D-Document": "D - Document Processing",
    "E-Multimodal": "E - Multimodal",
}
# Columns of the two CSV layouts; early files lack the last column.
COLUMNS = (
    "run_time", "system", "model", "task_id", "category", "agent", "success", "score", "escalated",
    "local_score", "latency_s", "cloud_calls", "cost_usd", "data_kb", "score_method", "judge_reason",
)
EARLY_COLUMNS = COLUMNS[:-1]

_TYPES = dict(item.split(" ", 1) for item in schemas.RESULT.split(", "))


def plain_agent(agent: Column) -> Column:
    """Agent name without the tier suffix in square brackets of early runs."""
    return F.regexp_replace(agent, r"\s*\[[A-Z]+\]\s*$", "")


def plain_category(category: Column) -> Column:
    """Current label of an early category, others unchanged."""
    label = category
    for early, current in CATEGORY_LABELS.items():
        label = F.when(category == early, F.lit(current)).otherwise(label)
    return label


def read_history_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Every line of history files with its layout, its record or the reason why it is none."""
    layouts = {
        name: ", ".join(f"{column} {_TYPES[column]}" for column in columns)
        for name, columns in (("current", COLUMNS), ("early", EARLY_COLUMNS))
    }
    return files.read_layouts(spark, paths, layouts, options={"timestampFormat": "yyyy-MM-dd HH:mm:ss"})


def history_records(lines: DataFrame) -> DataFrame:
    """Results of the readable lines of both layouts, labels made equal."""
    current, early = files.records(lines, "current"), files.records(lines, "early")
    merged = current.unionByName(early, allowMissingColumns=True)
    return merged.withColumns(
        {"category": plain_category(F.col("category")), "agent": plain_agent(F.col("agent"))}
    ).select(*COLUMNS)


def read_history(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Results from CSV files of the current and the early layout, also mixed within a file.

    Lines that cannot be read are left out here: :func:`read_history_lines` and ``files.quarantine`` have them.
    """
    if not paths:
        return spark.createDataFrame([], schemas.RESULT).select(*COLUMNS)
    return history_records(read_history_lines(spark, paths))


def tag_run(results: DataFrame, system: str, model: str) -> DataFrame:
    """Give all rows of a run one time, system and model, and put the judge's reason on one line.

    ``total_latency_s``, both tiers together, is that of the first answer where the results have no such column.
    """
    reason = F.regexp_replace(F.coalesce("judge_reason", F.lit("")), "\n", " ")
    total = F.col("total_latency_s") if "total_latency_s" in results.columns else F.col("latency_s")
    return results.withColumns(
        {
            "run_time": F.current_timestamp(),
            "system": F.lit(system),
            "model": F.lit(model),
            "judge_reason": reason,
            "total_latency_s": total,
        }
    ).select(*[F.col(name).cast(kind).alias(name) for name, kind in _TYPES.items()])


def append_results(tagged: DataFrame, path: str) -> None:
    """Append a tagged run to the history table, one folder per run date."""
    dated = tagged.withColumn("run_date", F.to_date("run_time"))
    dated.write.mode("append").partitionBy("run_date").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """History table written by :func:`append_results`; prunes on ``run_date``.

    The fixed schema also fits runs written before a column was added, which read as NULL there.
    """
    return spark.read.schema(f"{schemas.RESULT}, run_date DATE").parquet(path)


def export_csv(tagged: DataFrame, path: str, *, reason_chars: int | None = schemas.REASON_CHARS) -> None:
    """Append a run as CSV with a header in every file and NULL as an empty field.

    Reasons are cut to ``reason_chars`` here, as readers of these files expect; None keeps them whole.
    The history table always has them whole, and the latency of both tiers, which has no column in these files.
    """
    tagged = tagged.drop("total_latency_s")
    if reason_chars is not None and "judge_reason" in tagged.columns:
        tagged = tagged.withColumn("judge_reason", F.left("judge_reason", F.lit(reason_chars)))
    tagged.write.mode("append").csv(path, header=True, nullValue="", escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss")
