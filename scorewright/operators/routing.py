"""Which handler takes a task, and the prompt it is given."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.scale import literal_table, lookup_join

# Handler, tier and model of each agent.
ROUTES = (
    ("file_agent", "local", "qwen2.5:3b"),
    ("code_agent", "local", "qwen2.5:3b"),
    ("planning_agent", "local", "qwen2.5:3b"),
    ("document_agent", "local", "qwen2.5:3b"),
    ("multimodal_agent", "cloud", "gpt-4o"),
)
# Run modes, the model of the cloud-only mode, the agent that keeps its own route.
MODES = ("hybrid", "local_only", "cloud_only")
CLOUD_ONLY_MODEL = "gpt-4o-mini"
ALWAYS_OWN_ROUTE = "multimodal_agent"
QUARANTINE = "unroutable"


def route(
    tasks: DataFrame,
    *,
    agent: str = "agent",
    mode: str = "hybrid",
    routes: Sequence[tuple[str, str, str]] | DataFrame = ROUTES,
    strict: bool = False,
    spread: Sequence[str] = (),
) -> DataFrame:
    """Add ``tier`` and ``model``. Unknown agents get tier ``unroutable``, or fail when strict.

    ``routes`` are (agent, tier, model), as Python rows or as a table of any size, which is looked up
    with a size check; ``spread`` then names columns that tell tasks of one agent apart. Of several
    routes of one agent the first by tier and model counts.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if isinstance(routes, DataFrame):
        one = routes.groupBy(F.col("agent").alias(agent)).agg(F.min(F.struct("tier", "model")).alias("_route"))
        table = one.select(agent, "_route.tier", "_route.model")
        joined = lookup_join(tasks, table, [agent], spread=spread or tasks.columns[:1])
    else:
        table = literal_table(tasks.sparkSession, routes, "_agent STRING, tier STRING, model STRING")
        joined = tasks.join(table, F.col(agent) == F.col("_agent"), "left").drop("_agent")
    unknown = F.col("tier").isNull()
    tier, model = F.col("tier"), F.col("model")
    if mode == "cloud_only":
        to_cloud = ~unknown & (F.col(agent) != ALWAYS_OWN_ROUTE)
        tier = F.when(to_cloud, F.lit("cloud")).otherwise(tier)
        model = F.when(to_cloud, F.lit(CLOUD_ONLY_MODEL)).otherwise(model)
    fallback = F.raise_error(F.concat(F.lit("unknown agent: "), F.col(agent))) if strict else F.lit(QUARANTINE)
    return joined.withColumns({"tier": F.when(unknown, fallback).otherwise(tier), "model": model})


def render(template: Sequence[str | Column]) -> Column:
    """Concatenate literal text and columns; NULL columns count as empty text."""
    parts = [F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in template]
    return F.concat(*parts)


def fill(template: Column, fields: Sequence[str]) -> Column:
    """A template column with every ``{field}`` replaced by the value of that column, NULL by nothing.

    The template is cut at its places first, so a value that itself holds ``{field}`` stays as it is.
    """
    place = r"\{(?:" + "|".join(fields) + r")\}"
    parts = F.split(template, f"(?={place})|(?<={place})")

    def value(part: Column) -> Column:
        filled = part
        for field in fields:
            filled = F.when(part == F.lit("{" + field + "}"), F.coalesce(F.col(field).cast("string"), F.lit(""))).otherwise(filled)
        return filled

    return F.array_join(F.transform(parts, value), "")


def render_prompts(
    tasks: DataFrame,
    templates: Mapping[str, Sequence[str | Column]] | DataFrame,
    *,
    agent: str = "agent",
    default: Sequence[str | Column] | Mapping[str, Sequence[str | Column]],
    tier: str = "tier",
    fields: Sequence[str] = ("description", "input_text"),
    spread: Sequence[str] = (),
) -> DataFrame:
    """Add ``prompt``, from the template of the task's agent, and ``prompt_sha`` as its key.

    A template may leave columns out: one for code need not show the input, one for images need not
    show the description. ``templates`` maps agents to templates, or is a table ``agent, tier, template``
    of texts with places such as ``{description}`` (any of ``fields``): that of the task's agent and tier
    counts, else that of the agent with NULL as tier. What has no template takes ``default``, which may be
    a mapping from tiers.
    """
    if isinstance(default, Mapping):
        prompt = F.lit(None).cast("string")
        for name, template in default.items():
            prompt = F.when(F.col(tier) == name, render(template)).otherwise(prompt)
    else:
        prompt = render(default)
    found = tasks
    if isinstance(templates, DataFrame):
        known = templates.where(F.col("template").isNotNull()).groupBy("agent", "tier").agg(F.min("template").alias("_text"))
        exact = known.where(F.col("tier").isNotNull()).select(
            F.col("agent").alias(agent), F.col("tier").alias(tier), F.col("_text").alias("_exact")
        )
        general = known.where(F.col("tier").isNull()).select(F.col("agent").alias(agent), F.col("_text").alias("_general"))
        spread = spread or tasks.columns[:1]
        found = lookup_join(lookup_join(tasks, exact, [agent, tier], spread=spread), general, [agent], spread=spread)
        own = F.coalesce("_exact", "_general")
        prompt = F.when(own.isNotNull(), fill(own, fields)).otherwise(prompt)
    else:
        for name, template in templates.items():
            prompt = F.when(F.col(agent) == name, render(template)).otherwise(prompt)
    prompted = found.withColumn("prompt", prompt).withColumn("prompt_sha", F.sha2("prompt", 256))
    return prompted.drop("_exact", "_general")
