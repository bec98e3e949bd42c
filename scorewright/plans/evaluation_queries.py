"""Evaluation operators bound to the driver's tables.

The tables hold no task bank, so these stand in for it. Task: a user turn of ``conversations``.
Answer: the assistant turn right after it. Second-tier answer: the last assistant turn of the
conversation, if later. Judged result: ``labels.quality`` and ``toxic`` of a document, unlabelled
documents being skipped. Run: ``documents.source``. Category: ``documents.lang``. Tokens: words of
an answer, or ``documents.n_chars``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import numbers as N
from scorewright.functions import text as T
from scorewright.operators import accounting, cascade, inference, report, routing, scoring
from scorewright.operators import text as documents_ops
from scorewright.plans import run, sql
from scorewright.plans.registry import Tables, query
from scorewright.scale import materialize, scratch_path
from scorewright.sources import files, history, tasks

TAU = 0.10

# Words whose presence counts, per language of the test documents.
KEYWORDS = {"en": ["the", "and", "with"], "fr": ["dans", "avec"], "de": ["nicht"]}
TERMS = {
    "en": ["the", "and", "with", "that"],
    "fr": ["les", "des", "pour", "avec"],
    "de": ["der", "und", "nicht", "ist"],
    "es": ["los", "que", "para", "una"],
}
MODEL_BY_LANG = {"en": "gpt-4o-mini", "fr": "gpt-4o"}
EVENT_ROUTES = (
    ("view", "local", "qwen2.5:3b"),
    ("click", "local", "qwen2.5:3b"),
    ("error", "local", "qwen2.5:0.5b"),
    ("multimodal_agent", "cloud", "gpt-4o"),
    ("purchase", "cloud", "gpt-4o"),
)

_SQL_MODEL = "(CASE d.lang WHEN 'en' THEN 'gpt-4o-mini' WHEN 'fr' THEN 'gpt-4o' ELSE 'local' END)"
_SQL_RAW = "(CAST(l.quality * 2 + 1 - l.toxic AS DOUBLE) / 4)"


def _sql_list(terms: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def _model_of_lang() -> Column:
    model = F.lit("local")
    for lang, name in MODEL_BY_LANG.items():
        model = F.when(F.col("lang") == lang, F.lit(name)).otherwise(model)
    return model


def _judged_documents(t: Tables) -> DataFrame:
    """Documents with the score a judge would have recorded: 0, 0.25, 0.5 or 0.75, or none."""
    raw = (F.col("quality") * 2 + 1 - F.col("toxic")).cast("double") / 4
    return t.documents.join(t.labels, "doc_id", "left").withColumn("judged", raw)


def _results(t: Tables) -> DataFrame:
    """One result per document, in the shape the report operators take."""
    judged = _judged_documents(t)
    return judged.select(
        "doc_id",
        "source",
        "lang",
        (F.col("quality") == 1).alias("success"),
        F.col("judged").alias("score"),
        (F.col("toxic") == 1).alias("escalated"),
        F.when(F.col("toxic") == 1, F.col("judged") / 2).alias("local_score"),
        (F.col("n_chars") / F.lit(100.0)).alias("latency_s"),
        F.when(_model_of_lang() == "local", F.lit(0)).otherwise(F.lit(1)).alias("cloud_calls"),
        N.call_cost(F.col("n_chars"), _model_of_lang()).alias("cost_usd"),
        N.payload_kb(F.col("text")).alias("data_kb"),
        F.col("text").alias("output"),
    )


_SQL_RESULTS = f"""
results AS (
  SELECT d.doc_id, d.source, d.lang, l.quality = 1 AS success, {_SQL_RAW} AS score,
    l.toxic = 1 AS escalated, CASE WHEN l.toxic = 1 THEN {_SQL_RAW} / 2 END AS local_score,
    d.n_chars AS hundredths, CASE WHEN {_SQL_MODEL} = 'local' THEN 0 ELSE 1 END AS cloud_calls,
    {sql.micro_dollars('d.n_chars', _SQL_MODEL)} AS micros, {sql.kb('d.text')} AS data_kb, d.text AS output
  FROM documents d LEFT JOIN labels l USING (doc_id))
"""


@query(
    "task_bank_profile",
    """
    SELECT role, string_split(text, ' ')[1] AS first_token, count(*) AS n_tasks
    FROM conversations GROUP BY ALL
    """,
)
def task_bank_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks per role and first token."""
    turns = Tables(spark, folder).conversations
    return tasks.profile_tasks(
        turns.select("role", F.get(F.split("text", " "), 0).alias("first_token")), ["role", "first_token"]
    )


def _write_text_files(docs: DataFrame, label: str, by: str) -> str:
    """Write texts as files, one folder per value of ``by``; a large value is split over many files."""
    path = scratch_path(docs.sparkSession, label)
    docs.select(by, "text").hint("rebalance", by).write.partitionBy(by).option("maxRecordsPerFile", 1_000).text(path)
    return path


@query(
    "wholetext_inventory",
    """
    SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars
    FROM documents GROUP BY source
    """,
)
def wholetext_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as text files, read back whole, sizes per source folder."""
    path = _write_text_files(Tables(spark, folder).documents, "texts", "source")
    texts = files.read_whole_texts(spark, path, glob="*.txt")
    return (
        texts.withColumn("source", F.regexp_extract("path", "/source=([^/]+)/", 1))
        .groupBy("source")
        .agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))
    )


#: Bytes of one part in the queries that pack texts: small, so that conversations are cut.
PACKED = 1_000
_SQL_LABELLED = """
(SELECT conv_id, turn, '=== FILE: ' || role || '#' || turn || ' ===' || chr(10) || text AS block FROM conversations)
"""


@query(
    "labelled_concat",
    f"""
    SELECT conv_id, part, count(*) AS n_pieces, md5(string_agg(block, chr(10) || chr(10) ORDER BY turn)) AS text_md5
    FROM {sql.packed(_SQL_LABELLED, 'conv_id', 'turn', "(block || chr(10) || chr(10))", PACKED)} GROUP BY ALL
    """,
)
def labelled_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation as labelled blocks, in order, packed into texts of bounded size."""
    turns = Tables(spark, folder).conversations
    labelled = turns.withColumn("label", F.concat("role", F.lit("#"), F.col("turn").cast("string")))
    joined = tasks.concat_labelled(labelled, "conv_id", "turn", "label", "text", max_bytes=PACKED)
    return joined.select("conv_id", "part", "n_pieces", F.md5("text").alias("text_md5"))


@query(
    "missing_input_skip",
    f"""
    WITH {sql.PAIRS}
    SELECT conv_id, turn, reply IS NULL AS skipped,
      md5(coalesce(reply, '[SKIPPED] missing input')) AS output_md5
    FROM pairs
    """,
)
def missing_input_skip(spark: SparkSession, folder: str) -> DataFrame:
    """User turns without a reply keep their row and are marked as skipped."""
    pairs = tasks.pair_turns(Tables(spark, folder).conversations)
    found = pairs.select("conv_id", "turn", F.col("reply").isNotNull().alias("found"), F.col("reply").alias("output"))
    return tasks.mark_skipped(found, "found", "output").select("conv_id", "turn", "skipped", F.md5("output").alias("output_md5"))


def _files(t: Tables) -> DataFrame:
    """Documents as input files; every fourth one is missing."""
    held = t.documents.where(F.col("doc_id") % 4 != 0)
    return held.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("ref"), "text", F.octet_length("text").cast("bigint").alias("n_bytes")
    )


_SQL_FILES = "files AS (SELECT 'doc-' || doc_id AS ref, text FROM documents WHERE doc_id % 4 <> 0)"


@query(
    "resolve_inputs",
    f"""
    WITH {_SQL_FILES},
    bank AS (
      SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN ['doc-' || (conv_id % 60), 'doc-' || (7 * turn % 60), 'doc-' || (conv_id % 13)]
        WHEN role = 'assistant' THEN ['doc-' || (conv_id % 60)] END AS refs FROM conversations),
    wanted AS (SELECT conv_id, turn, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM bank),
    found AS (
      SELECT conv_id, turn, count(*) = count(text) AS complete, arg_min(ref, pos) FILTER (text IS NULL) AS missing_ref,
        string_agg('=== FILE: ' || ref || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS combined, arg_min(text, pos) AS first_text
      FROM wanted LEFT JOIN files USING (ref) GROUP BY ALL),
    resolved AS (
      SELECT b.conv_id, b.turn, coalesce(complete, TRUE) AS input_found, missing_ref,
        CASE WHEN refs IS NULL THEN b.text WHEN complete AND role = 'user' THEN combined WHEN complete THEN first_text END AS input_text
      FROM bank b LEFT JOIN found USING (conv_id, turn))
    SELECT conv_id || '-' || turn AS task_id, input_found, missing_ref, CAST(strlen(input_text) AS BIGINT) AS input_bytes, md5(input_text) AS input_md5
    FROM resolved
    """,
)
def resolve_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks with several files, one file or their own text; a missing file leaves a task without input."""
    t = Tables(spark, folder)

    def ref(number: Column) -> Column:
        return F.concat(F.lit("doc-"), number.cast("string"))

    several = F.array(ref(F.col("conv_id") % 60), ref(7 * F.col("turn") % 60), ref(F.col("conv_id") % 13))
    bank = t.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("task_id"),
        F.when(F.col("role") == "user", F.lit("multi")).otherwise(F.lit("document")).alias("input_type"),
        F.when(F.col("role") == "user", several).when(F.col("role") == "assistant", F.array(ref(F.col("conv_id") % 60))).alias("input_refs"),
        F.col("text").alias("inline_input"),
    )
    found = tasks.resolve_inputs(bank, _files(t))
    return found.select("task_id", "input_found", "missing_ref", "input_bytes", F.md5("input_text").alias("input_md5"))


_SQL_ROUTES = """
routes(agent, tier, model) AS (VALUES ('view', 'local', 'qwen2.5:3b'), ('click', 'local', 'qwen2.5:3b'),
  ('error', 'local', 'qwen2.5:0.5b'), ('multimodal_agent', 'cloud', 'gpt-4o'), ('purchase', 'cloud', 'gpt-4o'))
"""


@query(
    "route_tasks",
    f"""
    WITH {_SQL_ROUTES}
    SELECT event_type, coalesce(tier, 'unroutable') AS tier, model, count(*) AS n_tasks
    FROM events LEFT JOIN routes ON agent = event_type GROUP BY ALL
    """,
)
def route_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Handler, tier and model per event type; unknown types are quarantined."""
    routed = routing.route(Tables(spark, folder).events, agent="event_type", routes=EVENT_ROUTES)
    return routed.groupBy("event_type", "tier", "model").agg(F.count(F.lit(1)).alias("n_tasks"))


@query(
    "route_tasks_cloud_only",
    f"""
    WITH {_SQL_ROUTES}
    SELECT event_type, CASE WHEN tier IS NULL THEN 'unroutable' ELSE 'cloud' END AS tier,
      CASE WHEN tier IS NOT NULL THEN 'gpt-4o-mini' END AS model, count(*) AS n_tasks
    FROM events LEFT JOIN routes ON agent = event_type GROUP BY ALL
    """,
)
def route_tasks_cloud_only(spark: SparkSession, folder: str) -> DataFrame:
    """The same in cloud-only mode."""
    routed = routing.route(
        Tables(spark, folder).events, agent="event_type", routes=EVENT_ROUTES, mode="cloud_only"
    )
    return routed.groupBy("event_type", "tier", "model").agg(F.count(F.lit(1)).alias("n_tasks"))


def _prompted(t: Tables) -> DataFrame:
    asked = tasks.pair_turns(t.conversations).withColumn(
        "agent", F.when(F.col("turn") == 0, F.lit("document_agent")).otherwise(F.lit("planning_agent"))
    )
    return routing.render_prompts(
        asked,
        {"document_agent": ["Answer from this text alone:\n", F.col("question"), "\nAnswer:"]},
        default=["Give numbered steps for:\n", F.col("question")],
    )


_SQL_PROMPT = (
    "(CASE WHEN turn = 0 THEN 'Answer from this text alone:' || chr(10) || question || chr(10) || 'Answer:'"
    " ELSE 'Give numbered steps for:' || chr(10) || question END)"
)


@query(
    "render_prompts",
    f"""
    WITH {sql.PAIRS}
    SELECT conv_id, turn, CAST(length({_SQL_PROMPT}) AS BIGINT) AS prompt_chars, sha256({_SQL_PROMPT}) AS prompt_sha
    FROM pairs
    """,
)
def render_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """One prompt per user turn, by the template of its agent."""
    return _prompted(Tables(spark, folder)).select(
        "conv_id", "turn", F.length("prompt").cast("bigint").alias("prompt_chars"), "prompt_sha"
    )


_TEMPLATES = [
    ("document_agent", "local", "Read:\n{question}\nThen answer."),
    ("document_agent", None, "A second look at turn {turn}: {question}"),
    ("planning_agent", "cloud", "{question}{question} in steps"),
    ("planning_agent", "cloud", "~ never taken, as it sorts behind the other"),
    ("other_agent", "local", "never asked for"),
]
_SQL_TIERED = """
tiered AS (
  SELECT conv_id, turn, question, CASE WHEN turn = 0 THEN 'document_agent' ELSE 'planning_agent' END AS agent,
    CASE conv_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'cloud' ELSE 'second' END AS tier FROM pairs),
texts AS (
  SELECT conv_id, turn, CASE
    WHEN agent = 'document_agent' AND tier = 'local' THEN 'Read:' || chr(10) || question || chr(10) || 'Then answer.'
    WHEN agent = 'document_agent' THEN 'A second look at turn ' || turn || ': ' || question
    WHEN tier = 'cloud' THEN question || question || ' in steps'
    WHEN tier = 'second' THEN 'Again: ' || question ELSE 'First: ' || question END AS prompt FROM tiered)
"""


@query(
    "prompts_by_tier",
    f"WITH {sql.PAIRS}, {_SQL_TIERED} SELECT conv_id, turn, CAST(length(prompt) AS BIGINT) AS prompt_chars, sha256(prompt) AS prompt_sha FROM texts",
)
def prompts_by_tier(spark: SparkSession, folder: str) -> DataFrame:
    """Templates from a table by agent and tier, others by tier alone."""
    tier = F.when(F.col("conv_id") % 3 == 0, F.lit("local")).when(F.col("conv_id") % 3 == 1, F.lit("cloud")).otherwise(F.lit("second"))
    agent = F.when(F.col("turn") == 0, F.lit("document_agent")).otherwise(F.lit("planning_agent"))
    asked = tasks.pair_turns(Tables(spark, folder).conversations).withColumns({"agent": agent, "tier": tier})
    table = spark.createDataFrame(_TEMPLATES, "agent STRING, tier STRING, template STRING")
    prompted = routing.render_prompts(
        asked, table, default={"local": ["First: ", F.col("question")], "second": ["Again: ", F.col("question")]},
        fields=["question", "turn"], spread=["conv_id", "turn"],
    )
    return prompted.select("conv_id", "turn", F.length("prompt").cast("bigint").alias("prompt_chars"), "prompt_sha")


def _measured(prompt: str, model: str) -> tuple[str, int]:
    """Stands in for a model: an answer that follows from the prompt alone."""
    return f"{model}: {len(prompt)} characters", len(prompt) // 4


def _unreachable(prompt: str, model: str) -> tuple[str, int]:
    raise ConnectionError("the model is gone")


@query(
    "call_model_rounds",
    f"""
    WITH {sql.PAIRS}
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'large' ELSE 'small' END || ': ' || length(question) || ' characters' AS output,
      CAST(length(question) // 4 AS BIGINT) AS tokens, NULL::VARCHAR AS error
    FROM pairs WHERE question IS NOT NULL
    """,
)
def call_model_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct prompts answered in four rounds, each stored as it ends; a second run finds all it needs there."""
    turns = tasks.pair_turns(Tables(spark, folder).conversations).where(F.col("question").isNotNull())
    model = F.when(F.col("turn") % 2 == 0, F.lit("large")).otherwise(F.lit("small"))
    prompts = turns.select(
        "conv_id", "turn", F.sha2("question", 256).alias("prompt_sha"), model.alias("model"), F.col("question").alias("prompt")
    )
    path = scratch_path(spark, "responses")
    inference.call_model(prompts, _measured, path, parallel_calls=8, rounds=4)
    stored = inference.call_model(prompts, _unreachable, path, parallel_calls=8, rounds=4)
    replayed = inference.replay(prompts, stored, spread=["conv_id", "turn"], keys=("prompt_sha", "model"))
    return replayed.select("conv_id", "turn", "output", "tokens", "error")


@query(
    "replay_responses",
    f"""
    WITH {sql.PAIRS},
    prompts AS (SELECT conv_id, turn, reply, sha256({_SQL_PROMPT}) AS prompt_sha FROM pairs),
    recorded AS (
      SELECT prompt_sha, reply FROM prompts WHERE reply IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY prompt_sha ORDER BY conv_id, turn) = 1)
    SELECT p.conv_id, p.turn, md5(coalesce(r.reply, '')) AS output_md5,
      CAST(coalesce(len({sql.words('r.reply')}), 0) AS BIGINT) AS tokens,
      CASE WHEN r.reply IS NULL THEN 'no recorded response' END AS error
    FROM prompts p LEFT JOIN recorded r USING (prompt_sha)
    """,
)
def replay_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded replies attached to prompts by prompt hash."""
    prompts = materialize(_prompted(Tables(spark, folder)).select("conv_id", "turn", "reply", "prompt_sha"), "prompts")
    recorded = (
        prompts.where(F.col("reply").isNotNull())
        .groupBy("prompt_sha")
        .agg(F.min_by("reply", F.struct("conv_id", "turn")).alias("output"))
        .select(
            "prompt_sha",
            "output",
            F.size(T.words(F.col("output"))).cast("bigint").alias("tokens"),
            F.lit(0.0).alias("latency_s"),
            F.lit(None).cast("string").alias("error"),
        )
    )
    answered = inference.replay(
        prompts.select("conv_id", "turn", "prompt_sha"), recorded, spread=["conv_id", "turn"]
    )
    return answered.select("conv_id", "turn", F.md5("output").alias("output_md5"), "tokens", "error")


@query(
    "binary_manifest",
    """
    SELECT lang, 'text/txt' AS mime, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes,
      CAST(sum(strlen(text) + 1) AS BIGINT) AS decoded_bytes
    FROM documents GROUP BY lang
    """,
)
def binary_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files written from documents, as bytes in base64 with type and size, per language."""
    path = _write_text_files(Tables(spark, folder).documents, "binaries", "lang")
    manifest = files.binary_manifest(spark, path, kind="text").where(F.endswith(F.col("path"), F.lit(".txt")))
    return (
        manifest.withColumn("lang", F.regexp_extract("path", "/lang=([^/]+)/", 1))
        .groupBy("lang", "mime")
        .agg(
            F.sum("n_bytes").alias("n_bytes"),
            F.sum(F.octet_length(F.unbase64("base64"))).cast("bigint").alias("decoded_bytes"),
        )
    )


@query(
    "parse_structured_output",
    """
    SELECT event_type, count(*) AS n_answers, count(*) FILTER (event_type <> 'error') AS n_valid,
      count(*) FILTER (event_type <> 'error') AS n_items,
      CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END) AS BIGINT) AS sum_k
    FROM events GROUP BY event_type
    """,
)
def parse_structured_output(spark: SparkSession, folder: str) -> DataFrame:
    """JSON arrays out of answers; views come fenced, errors come cut off."""
    array = F.concat(F.lit("["), F.col("props"), F.lit("]"))
    raw = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), array, F.lit("\n```")))
        .when(F.col("event_type") == "error", F.concat(F.lit("[{"), F.col("props")))
        .otherwise(array)
    )
    answers = Tables(spark, folder).events.select("event_type", raw.alias("raw"))
    parsed = inference.parse_items(answers, "raw", "ARRAY<STRUCT<k: BIGINT>>")
    items = parsed.select("event_type", "valid", F.size("items").alias("n"), F.aggregate(
        F.transform("items", lambda i: i["k"]), F.lit(0).cast("bigint"), lambda a, b: a + b
    ).alias("k"))
    return items.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.count_if("valid").alias("n_valid"),
        F.sum("n").cast("bigint").alias("n_items"),
        F.sum(F.when(F.col("valid"), F.col("k"))).alias("sum_k"),
    )


@query(
    "extract_code_blocks",
    f"""
    WITH fenced AS (
      SELECT doc_id, lang, translate({sql.strip("CASE lang WHEN 'es' THEN 'rust' || chr(10) || text ELSE text END")},
        '‘’“”', '''''""') AS code FROM documents)
    SELECT doc_id, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'sql' WHEN 'es' THEN 'rust' ELSE '' END AS tag,
      md5(code) AS code_md5, CAST(length(code) AS BIGINT) AS n_chars FROM fenced
    """,
)
def extract_code_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents wrapped into fenced answers, their block taken out again."""
    tag = (
        F.when(F.col("lang") == "en", F.lit("Python"))
        .when(F.col("lang") == "fr", F.lit("sql "))
        .when(F.col("lang") == "es", F.lit("rust"))
        .otherwise(F.lit(""))
    )
    raw = F.concat(F.lit("Here it is:\n```"), tag, F.lit("\n"), F.col("text"), F.lit("\n```\nThat is all."))
    answers = Tables(spark, folder).documents.select("doc_id", raw.alias("raw"))
    return documents_ops.extract_code(answers, "raw").select(
        "doc_id", "tag", F.md5("code").alias("code_md5"), F.length("code").cast("bigint").alias("n_chars")
    )


@query(
    "normalise_quotes",
    """
    SELECT doc_id, lang <> 'en' OR translate(text, '‘’“”', '''''""') <> text AS changed,
      md5(translate(CASE WHEN lang = 'en' THEN text ELSE '“' || text || '”' END, '‘’“”', '''''""')) AS plain_md5
    FROM documents
    """,
)
def normalise_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Typographic quotes made plain; all but English documents are put in such quotes first."""
    raw = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat(F.lit("“"), F.col("text"), F.lit("”")))
    answers = Tables(spark, folder).documents.select("doc_id", raw.alias("raw"))
    return documents_ops.normalise_quotes(answers, "raw").select("doc_id", "changed", F.md5("plain").alias("plain_md5"))


@query(
    "code_syntax_gate",
    "SELECT lang, lang IN ('en', 'es') AS passed, count(*) AS n_docs FROM documents GROUP BY ALL",
)
def code_syntax_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Code around each whole document: a function, a value, a broken head, a lambda."""
    literal = F.to_json(F.struct(F.col("text").alias("t")))
    code = (
        F.when(F.col("lang") == "en", F.concat(F.lit("def answer():\n    return "), literal))
        .when(F.col("lang") == "es", F.concat(F.lit("answer = lambda: "), literal))
        .when(F.col("lang") == "de", F.concat(F.lit("def answer(\n    return "), literal))
        .otherwise(F.concat(F.lit("answer = "), literal))
    )
    docs = Tables(spark, folder).documents
    checked = inference.code_gate(docs.select(F.col("lang"), code.alias("code")), "lang", "code")
    return checked.groupBy("lang", "passed").agg(F.count(F.lit(1)).alias("n_docs"))


@query(
    "call_cost",
    f"""
    SELECT doc_id, {_SQL_MODEL} AS model, n_chars AS tokens,
      CAST({sql.micro_dollars('n_chars', _SQL_MODEL)} AS DOUBLE) / 1000000 AS cost_usd
    FROM documents d
    """,
)
def call_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Cost per call by model."""
    calls = Tables(spark, folder).documents.select(
        "doc_id", _model_of_lang().alias("model"), F.col("n_chars").alias("tokens")
    )
    return accounting.price_calls(calls).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("payload_kb", f"SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, {sql.kb('text')} AS data_kb FROM documents")
def payload_kb(spark: SparkSession, folder: str) -> DataFrame:
    """UTF-8 size of each document."""
    sized = accounting.size_payloads(Tables(spark, folder).documents, "text")
    return sized.select("doc_id", "n_bytes", F.col("data_kb").cast("double").alias("data_kb"))


@query(
    "accumulate_calls",
    f"""
    WITH calls AS (
      SELECT conv_id, CAST(len({sql.words('text')}) AS BIGINT) AS tokens, strlen(text) AS n_bytes
      FROM conversations WHERE role = 'assistant')
    SELECT conv_id, count(*) AS cloud_calls, CAST(sum(tokens) AS BIGINT) AS tokens,
      CAST(sum((tokens * 33 + 50) // 100) AS DOUBLE) / 1000000 AS cost_usd,
      CAST(sum((2000 * n_bytes + 1024) // 2048) AS DOUBLE) / 1000 AS data_kb
    FROM calls GROUP BY conv_id
    """,
)
def accumulate_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, tokens, cost and size per conversation; each assistant turn is one call."""
    turns = Tables(spark, folder).conversations.where(F.col("role") == "assistant")
    calls = turns.select(
        "conv_id", "text", F.size(T.words(F.col("text"))).cast("bigint").alias("tokens"), F.lit("gpt-4o-mini").alias("model")
    )
    sized = accounting.size_payloads(accounting.price_calls(calls), "text")
    totals = accounting.accumulate_calls(sized, ["conv_id"])
    return totals.withColumns({c: F.col(c).cast("double") for c in ("cost_usd", "data_kb")})


_SQL_KEYWORDS = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in KEYWORDS.items()) + " END"
_SQL_HEURISTIC = f"""
heuristic AS (
  SELECT doc_id, length({sql.strip('text')}) AS n, {_SQL_KEYWORDS} AS kws,
    len(list_filter({_SQL_KEYWORDS}, lambda k: contains(lower(text), k))) > 0 AS hit FROM documents)
"""
_SQL_PASSED = "CASE WHEN n < 20 THEN FALSE WHEN kws IS NULL THEN n > 30 ELSE hit END"
_SQL_METHOD = (
    "CASE WHEN n < 20 THEN 'heuristic (output too short)' WHEN kws IS NULL THEN 'heuristic (non-empty)'"
    " ELSE 'heuristic (keyword match)' END"
)


@query(
    "heuristic_score",
    f"WITH {_SQL_HEURISTIC} SELECT doc_id, {_SQL_PASSED} AS passed, {_SQL_METHOD} AS score_method FROM heuristic",
)
def heuristic_score(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword rule per document."""
    keywords = scoring.term_list(F.col("lang"), KEYWORDS)
    return scoring.heuristic_score(Tables(spark, folder).documents, "text", keywords).select(
        "doc_id", "passed", "score_method"
    )


@query(
    "judge_gate",
    f"""
    WITH raw AS (
      SELECT doc_id, CASE WHEN lang = 'es' THEN NULL WHEN {sql.strip('text')} = '' THEN 0.0 ELSE {_SQL_RAW} END AS raw_score,
        CASE WHEN lang = 'es' THEN 'no criteria' WHEN {sql.strip('text')} = '' THEN 'no output' END AS judge_reason
      FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, raw_score, round(raw_score, 3) AS score, raw_score >= 0.5 AS passed, judge_reason FROM raw
    """,
)
def judge_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded judge scores with their guards; Spanish documents have no criteria."""
    criteria = F.when(F.col("lang") != "es", F.lit("is it good"))
    gated = scoring.judge_gate(
        _judged_documents(Tables(spark, folder)), output=F.col("text"), criteria=criteria, raw_score=F.col("judged")
    )
    return gated.select("doc_id", "raw_score", "score", "passed", "judge_reason")


@query(
    "score_dispatch",
    f"""
    WITH {_SQL_HEURISTIC},
    moded AS (
      SELECT d.doc_id, CASE lang WHEN 'de' THEN 'execution' WHEN 'fr' THEN 'criteria_only' ELSE 'expected' END AS mode,
        coalesce(l.quality = 1, FALSE) AS executes, {_SQL_RAW} AS judged, n, kws, hit
      FROM documents d LEFT JOIN labels l USING (doc_id) JOIN heuristic h ON h.doc_id = d.doc_id)
    SELECT doc_id, mode,
      CASE WHEN mode = 'execution' THEN executes WHEN judged IS NOT NULL THEN judged >= 0.5 ELSE {_SQL_PASSED} END AS success,
      CASE WHEN mode <> 'execution' THEN round(judged, 3) END AS score,
      CASE WHEN mode = 'execution' THEN 'automated (syntax check)' WHEN judged IS NOT NULL THEN 'judge (' || mode || ')'
        ELSE {_SQL_METHOD} END AS score_method
    FROM moded
    """,
)
def score_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Scoring mode by language; unlabelled documents fall to the keyword rule."""
    mode = (
        F.when(F.col("lang") == "de", F.lit("execution"))
        .when(F.col("lang") == "fr", F.lit("criteria_only"))
        .otherwise(F.lit("expected"))
    )
    scored = scoring.dispatch(
        _judged_documents(Tables(spark, folder)).withColumn("mode", mode),
        mode=F.col("mode"),
        output=F.col("text"),
        keywords=scoring.term_list(F.col("lang"), KEYWORDS),
        executes=F.coalesce(F.col("quality") == 1, F.lit(False)),
        judged=F.col("judged"),
    )
    return scored.select("doc_id", "mode", "success", "score", "score_method")


@query(
    "token_f1",
    f"""
    WITH {sql.PAIRS}, {sql.f1('f', 'pairs', 'reply', 'question')}
    SELECT conv_id, turn, CAST(overlap AS BIGINT) AS n_shared, CAST(size AS BIGINT) AS n_words, {sql.f1_score('f')} AS score FROM f
    """,
)
def token_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Word-multiset F1 of each reply against its question."""
    pairs = tasks.pair_turns(Tables(spark, folder).conversations)
    scored = scoring.token_f1(pairs, ["conv_id", "turn"], {"score": "reply"}, "question")
    return scored.select(
        "conv_id", "turn", F.col("score_overlap").alias("n_shared"), F.col("score_size").alias("n_words"), "score"
    )


@query(
    "criteria_coverage",
    "WITH terms AS (SELECT doc_id, lower(text) AS t, CASE lang "
    + " ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in TERMS.items())
    + " END AS terms FROM documents), found AS (SELECT doc_id, len(terms) AS n, len(list_filter(terms, lambda k: contains(t, k))) AS f FROM terms)"
    + f" SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_terms, CAST(f AS BIGINT) AS n_present, {sql.ratio('f', 'n', 3)} AS coverage FROM found",
)
def criteria_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the language's required terms found in each document."""
    terms = scoring.term_list(F.col("lang"), TERMS)
    covered = scoring.coverage(Tables(spark, folder).documents, "text", terms)
    return covered.select("doc_id", "n_terms", "n_present", "coverage")


@query(
    "escalation_candidates",
    f"""
    WITH {sql.PAIRS}, {sql.f1('f', 'pairs', 'reply', 'question')}
    SELECT conv_id, turn, {sql.f1_score('f')} AS score FROM f WHERE {sql.f1_score('f')} < {TAU}
    """,
)
def escalation_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Answered turns whose reply scores below the threshold."""
    pairs = tasks.pair_turns(Tables(spark, folder).conversations)
    scored = scoring.token_f1(pairs, ["conv_id", "turn"], {"score": "reply"}, "question")
    weak = cascade.needs_escalation(F.col("score"), F.lit(None).cast("boolean"), threshold=TAU)
    return scored.where(weak).select("conv_id", "turn", "score")


def _both_tiers(t: Tables) -> DataFrame:
    """User turns with reply, fallback and the scores of both, from one pass over the words.

    Stored, since both tiers of the cascade read it.
    """
    turns = t.conversations
    asked = cascade.last_reply(tasks.pair_turns(turns), turns)
    scores = scoring.token_f1(asked, ["conv_id", "turn"], {"first": "reply", "second": "fallback"}, "question")
    return materialize(asked.join(scores, ["conv_id", "turn"]), "tiers")


_SQL_TIERS = f"""
{sql.PAIRS},
last_reply AS (
  SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
asked AS (
  SELECT p.*, CASE WHEN l.turn > p.turn THEN l.text END AS fallback FROM pairs p LEFT JOIN last_reply l USING (conv_id)),
{sql.f1('f', 'asked', 'reply', 'question')}, {sql.f1('g', 'asked', 'fallback', 'question')},
tiers AS (
  SELECT a.conv_id, a.turn, a.reply, a.fallback, {sql.f1_score('f')} AS s1, {sql.f1_raw('f')} AS r1,
    {sql.f1_score('g')} AS s2, {sql.f1_raw('g')} AS r2, CAST(len({sql.words('a.fallback')}) AS BIGINT) AS tokens2
  FROM asked a JOIN f USING (conv_id, turn) JOIN g USING (conv_id, turn))
"""


@query(
    "cascade_merge",
    f"""
    WITH {_SQL_TIERS}, merged AS (SELECT *, coalesce(s1 < {TAU}, FALSE) AND fallback IS NOT NULL AS e FROM tiers)
    SELECT conv_id, turn, CASE WHEN e THEN r2 >= {TAU} ELSE r1 >= {TAU} END AS success, CASE WHEN e THEN s2 ELSE s1 END AS score,
      e AS escalated, CASE WHEN e THEN s1 END AS local_score, md5(CASE WHEN e THEN fallback ELSE reply END) AS output_md5,
      CAST(e AS BIGINT) AS cloud_calls, CASE WHEN e THEN tokens2 ELSE 0 END AS tokens,
      CASE WHEN e THEN CAST((tokens2 * 33 + 50) // 100 AS DOUBLE) / 1000000 ELSE 0.0 END AS cost_usd,
      CASE WHEN coalesce(s1 < {TAU}, FALSE) AND NOT e THEN 'no second-tier answer' END AS error
    FROM merged
    """,
)
def cascade_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Weak replies replaced by the conversation's last reply, with scores and cost of both."""
    tiers = _both_tiers(Tables(spark, folder))
    first = tiers.select(
        "conv_id", "turn", F.col("reply").alias("output"), F.col("first_raw").alias("raw_score"),
        F.col("first").alias("score"), (F.col("first_raw") >= TAU).alias("success"),
    )
    second = tiers.where((F.col("first") < TAU) & F.col("fallback").isNotNull()).select(
        "conv_id", "turn", F.col("fallback").alias("output"), F.col("second_raw").alias("raw_score"),
        F.size(T.words(F.col("fallback"))).cast("bigint").alias("tokens"), F.lit("gpt-4o-mini").alias("model"),
    )
    merged = cascade.merge_tiers(first, second, ["conv_id", "turn"], threshold=TAU, pass_threshold=TAU)
    return merged.select(
        "conv_id", "turn", "success", "score", "escalated", "local_score", F.md5("output").alias("output_md5"),
        "cloud_calls", "tokens", F.col("cost_usd").cast("double").alias("cost_usd"), "error",
    )


@query(
    "mode_compare",
    f"""
    WITH {_SQL_TIERS},
    flagged AS (SELECT *, coalesce(s1 < {TAU}, FALSE) AND fallback IS NOT NULL AS e,
      coalesce((tokens2 * 33 + 50) // 100, 0) AS micros FROM tiers),
    modes AS (
      SELECT 'local_only' AS mode, r1 AS r, FALSE AS c, micros FROM flagged
      UNION ALL SELECT 'hybrid', CASE WHEN e THEN r2 ELSE r1 END, e, micros FROM flagged
      UNION ALL SELECT 'cloud_only', r2, r2 IS NOT NULL, micros FROM flagged)
    SELECT mode, count(*) AS n_tasks, count(r) AS n_scored, count(*) FILTER (r >= {TAU}) AS n_passed,
      {sql.ratio('CAST(sum(CAST(round(r * 1000) AS BIGINT)) AS BIGINT)', 'count(r) * 1000', 3)} AS mean_score,
      count(*) FILTER (c) AS cloud_calls, CAST(coalesce(sum(micros) FILTER (c), 0) AS DOUBLE) / 1000000 AS cost_usd
    FROM modes GROUP BY mode
    """,
)
def mode_compare(spark: SparkSession, folder: str) -> DataFrame:
    """The same tasks answered local-only, hybrid and cloud-only."""
    tiers = _both_tiers(Tables(spark, folder)).withColumn(
        "second_cost", N.call_cost(F.size(T.words(F.col("fallback"))), F.lit("gpt-4o-mini"))
    )
    return cascade.compare_modes(
        tiers, first_score="first_raw", second_score="second_raw", second_cost="second_cost",
        threshold=TAU, pass_threshold=TAU,
    )


def _run_bank(t: Tables) -> tuple[DataFrame, DataFrame]:
    """User turns as tasks, with their reply and the conversation's last one: a file each fifth, an unknown agent each tenth."""
    asked = cascade.last_reply(tasks.pair_turns(t.conversations), t.conversations)
    from_file = F.col("conv_id") % 5 == 1
    named = asked.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("task_id"),
        F.lit("D - Document Processing").alias("category"),
        F.when(F.col("conv_id") % 10 == 3, F.lit("ghost_agent")).otherwise(F.lit("document_agent")).alias("agent"),
        F.lit("Reply to the user.").alias("description"),
        F.when(from_file, F.lit("document")).otherwise(F.lit("text")).alias("input_type"),
        F.when(from_file, F.array(F.concat(F.lit("doc-"), (F.col("conv_id") % 40).cast("string")))).alias("input_refs"),
        F.when(~from_file, F.col("question")).alias("inline_input"),
        F.lit("expected").alias("scoring_mode"),
        F.lit("is it a reply").alias("criteria"),
        F.col("question").alias("expected_output"),
        "conv_id", "turn", "reply", "fallback",
    )
    return named.drop("conv_id", "turn", "reply", "fallback"), named


_SQL_RUN = f"""
{sql.PAIRS}, {_SQL_FILES},
last_reply AS (
  SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
asked AS (
  SELECT p.*, CASE WHEN l.turn > p.turn THEN l.text END AS fallback, CASE WHEN p.conv_id % 5 = 1 THEN 'doc-' || (p.conv_id % 40) END AS ref,
    p.conv_id % 10 = 3 AS ghost
  FROM pairs p LEFT JOIN last_reply l USING (conv_id)),
inputs AS (SELECT a.*, CASE WHEN a.ref IS NULL THEN question ELSE f.text END AS input FROM asked a LEFT JOIN files f ON f.ref = a.ref),
ones AS (SELECT input, arg_min(reply, conv_id * 1000000 + turn) AS answer1 FROM inputs WHERE reply IS NOT NULL AND input IS NOT NULL GROUP BY input),
twos AS (SELECT input, arg_min(fallback, conv_id * 1000000 + turn) AS answer2 FROM inputs WHERE fallback IS NOT NULL AND input IS NOT NULL GROUP BY input),
answered AS (
  SELECT i.*, answer1 IS NULL AS silent, coalesce(answer1, '') AS one, answer2 AS two
  FROM inputs i LEFT JOIN ones USING (input) LEFT JOIN twos USING (input) WHERE NOT ghost AND input IS NOT NULL),
{sql.f1('f', 'answered', 'one', 'question')}, {sql.f1('g', 'answered', 'two', 'question')},
tiers AS (
  SELECT a.*, {sql.f1_score('f')} AS s1, {sql.f1_raw('f')} AS r1, {sql.f1_score('g')} AS s2, {sql.f1_raw('g')} AS r2,
    CAST(len({sql.words('a.two')}) AS BIGINT) AS tokens2, s1 < 0.5 AND two IS NOT NULL AS e
  FROM answered a JOIN f USING (conv_id, turn) JOIN g USING (conv_id, turn))
"""


@query(
    "evaluate_run",
    f"""
    WITH {_SQL_RUN}
    SELECT conv_id || '-' || turn AS task_id, CASE WHEN e THEN r2 >= 0.5 ELSE r1 >= 0.5 END AS success, CASE WHEN e THEN s2 ELSE s1 END AS score,
      e AS escalated, CASE WHEN e THEN s1 END AS local_score, CAST(e AS INTEGER) AS cloud_calls,
      CASE WHEN e THEN CAST((tokens2 * 33 + 50) // 100 AS DOUBLE) / 1000000 ELSE 0.0 END AS cost_usd,
      CASE WHEN e THEN {sql.kb('input')} ELSE 0.0 END AS data_kb, 'judge (expected)' AS score_method,
      md5(CASE WHEN e THEN two ELSE one END) AS output_md5,
      CASE WHEN silent THEN 'no recorded response' WHEN s1 < 0.5 AND NOT e THEN 'no second-tier answer' END AS error
    FROM tiers
    UNION ALL
    SELECT conv_id || '-' || turn, NULL, NULL, FALSE, NULL, 0, 0.0, 0.0, '', md5('[SKIPPED] ' || why), why FROM (
      SELECT *, CASE WHEN input IS NULL THEN 'missing input file: ' || ref ELSE 'unknown agent: ghost_agent' END AS why
      FROM inputs WHERE ghost OR input IS NULL)
    """,
)
def evaluate_run(spark: SparkSession, folder: str) -> DataFrame:
    """A whole run in hybrid mode: inputs, routing, prompts of both models, recorded answers, scores, cascade, cost."""
    t = Tables(spark, folder)
    bank, asked = _run_bank(t)
    held = _files(t)
    given = materialize(tasks.resolve_inputs(asked, held).where("input_found"), "given")

    def recorded(tier: str, column: str):
        """The first of the recorded answers of one prompt, as a model's."""
        by_prompt = given.where(F.col(column).isNotNull()).select(
            F.sha2(routing.render(run.default_templates()[tier]), 256).alias("prompt_sha"), column, "conv_id", "turn"
        )
        one = by_prompt.groupBy("prompt_sha").agg(F.min_by(column, F.struct("conv_id", "turn")).alias("output"))

        def answer(prompts: DataFrame) -> DataFrame:
            models = prompts.select("model").distinct()
            return one.join(F.broadcast(models)).select(
                "prompt_sha", "model", "output", F.size(T.words(F.col("output"))).cast("bigint").alias("tokens"),
                F.lit(0.25).alias("latency_s"), F.lit(None).cast("string").alias("error"),
            )

        return answer

    results = run.evaluate(bank, held, answer=recorded("local", "reply"), escalate=recorded(run.SECOND, "fallback"))
    return results.select(
        "task_id", "success", "score", "escalated", "local_score", "cloud_calls", F.col("cost_usd").cast("double").alias("cost_usd"),
        F.col("data_kb").cast("double").alias("data_kb"), "score_method", F.md5("output").alias("output_md5"), "error",
    )


@query(
    "judge_inputs",
    f"""
    SELECT doc_id, source AS input, md5(text) AS actual_md5, CASE WHEN lang = 'en' THEN lang END AS expected_output
    FROM documents WHERE lang NOT IN ('de', 'es') AND {sql.strip('text')} <> ''
    """,
)
def judge_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """What a judge is shown: German documents are code, Spanish ones without criteria, French ones scored by criteria alone."""
    mode = F.when(F.col("lang") == "de", F.lit("execution")).when(F.col("lang") == "fr", F.lit("criteria_only")).otherwise(F.lit("expected"))
    answers = Tables(spark, folder).documents.select(
        "doc_id", mode.alias("scoring_mode"), F.when(F.col("lang") != "es", F.lit("is it good")).alias("criteria"),
        F.col("source").alias("description"), F.col("text").alias("output"), F.col("lang").alias("expected_output"),
    )
    cases = scoring.judge_inputs(answers, ["doc_id"])
    return cases.select("doc_id", "input", F.md5("actual_output").alias("actual_md5"), "expected_output")


_SQL_FED = """
(SELECT conv_id, turn, 'Task ' || turn || ' (' || role || '):' || chr(10) || text AS block
 FROM conversations WHERE text <> '' AND NOT contains(text, '[SKIPPED]'))
"""


@query(
    "synthesis_feed",
    f"""
    SELECT conv_id, part, count(*) AS n_outputs, md5(string_agg(block, chr(10) || chr(10) ORDER BY turn)) AS feed_md5
    FROM {sql.packed(_SQL_FED, 'conv_id', 'turn', "(block || chr(10) || chr(10))", PACKED)} GROUP BY ALL
    """,
)
def synthesis_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The outputs of each conversation as ordered texts of bounded size."""
    feed = report.synthesis_feed(
        Tables(spark, folder).conversations, "conv_id", "turn", "role", "text", max_bytes=PACKED
    )
    return feed.select("conv_id", "part", "n_outputs", F.md5("feed").alias("feed_md5"))


@query(
    "report_rows",
    f"""
    WITH {_SQL_RESULTS}
    SELECT doc_id, CASE WHEN success IS NULL THEN 'SKIP' WHEN success THEN 'PASS' ELSE 'FAIL' END AS result,
      coalesce(printf('%.3f', score), '-') AS score, CASE WHEN escalated THEN 'YES' ELSE 'no' END AS escalated,
      printf('%.2f', hundredths / 100.0) || 's' AS latency,
      '$' || CAST(CAST(micros AS DECIMAL(18,6)) / 1000000 AS DECIMAL(18,6)) AS cost,
      CAST(CAST(round(CAST(data_kb AS DECIMAL(18,3)), 2) AS DECIMAL(18,2)) AS VARCHAR) || ' KB' AS data,
      md5(left(output, 300) || CASE WHEN length(output) > 300 THEN '...' ELSE '' END) AS preview_md5,
      md5(output) AS output_md5
    FROM results
    """,
)
def report_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Display form of each result."""
    rows = report.report_rows(_results(Tables(spark, folder)), ["doc_id"])
    hashed = {"preview_md5": F.md5("preview"), "output_md5": F.md5("output")}
    return rows.withColumns(hashed).drop("preview", "output")


def _sql_summary(by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""
    WITH {_SQL_RESULTS}
    SELECT {keys}count(*) AS n_tasks, count(success) AS n_scored, count(*) FILTER (success) AS n_passed,
      {sql.ratio('count(*) FILTER (success) * 100', 'count(success)', 0)} AS pass_rate_pct,
      {sql.ratio('CAST(sum(hundredths) AS BIGINT)', 'count(*) * 100', 2)} AS mean_latency_s,
      CAST(sum(cloud_calls) AS BIGINT) AS cloud_calls, CAST(sum(micros) AS DOUBLE) / 1000000 AS cost_usd
    FROM results{group}
    """


@query("run_summary", _sql_summary(""))
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over all results; unlabelled documents count as skipped."""
    return report.run_summary(_results(Tables(spark, folder)))


@query("run_summary_by_source", _sql_summary("source"))
def run_summary_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """The same per run."""
    return report.run_summary(_results(Tables(spark, folder)), ["source"])


@query(
    "judge_reasons",
    f"""
    SELECT doc_id, CASE WHEN lang <> 'es' THEN round(CASE WHEN {sql.strip('text')} = '' THEN 0.0 ELSE {_SQL_RAW} END, 3) END AS score,
      CASE WHEN lang = 'es' THEN 'no criteria' WHEN {sql.strip('text')} = '' THEN 'no output'
        ELSE 'quality ' || l.quality END AS judge_reason
    FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE lang = 'es' OR {sql.strip('text')} = '' OR l.quality IS NOT NULL
    """,
)
def judge_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Results that carry a judge's reason."""
    gated = scoring.judge_gate(
        _judged_documents(Tables(spark, folder)), output=F.col("text"),
        criteria=F.when(F.col("lang") != "es", F.lit("is it good")), raw_score=F.col("judged"),
        reason=F.concat(F.lit("quality "), F.col("quality").cast("string")),
    )
    return report.judge_reasons(gated, ["doc_id"])


@query(
    "orchestration_overhead",
    f"""
    WITH calls AS (SELECT role, CAST(len({sql.words('text')}) AS BIGINT) AS tokens FROM conversations WHERE role <> 'assistant')
    SELECT role, count(*) AS n_calls, CAST(sum(tokens) AS BIGINT) AS tokens,
      CAST((sum(tokens) * 33 + 50) // 100 AS DOUBLE) / 1000000 AS cost_usd
    FROM calls GROUP BY role
    """,
)
def orchestration_overhead(spark: SparkSession, folder: str) -> DataFrame:
    """Cost of the calls around the tasks; system and user turns stand in for them."""
    turns = Tables(spark, folder).conversations.where(F.col("role") != "assistant")
    calls = turns.select("role", F.size(T.words(F.col("text"))).cast("bigint").alias("tokens"))
    totals = accounting.overhead(calls, ["role"], model="gpt-4o-mini")
    return totals.withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query(
    "run_comparison",
    f"""
    WITH {_SQL_RESULTS},
    dated AS (
      SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'qwen2.5:0.5b' ELSE 'qwen2.5:3b' END AS model,
        TIMESTAMP '2025-01-01' - to_seconds(7919 * doc_id % 100003) AS happened FROM results),
    rated AS (
      SELECT source, model, lang, grouping(lang) = 1 AS is_total, min(happened) AS begun, count(*) AS n_tasks, count(success) AS n_scored,
        count(*) FILTER (success) AS n_passed,
        {sql.ratio('count(*) FILTER (success) * 100', 'count(success)', 3)} AS pass_rate_pct,
        {sql.ratio('CAST(sum(CAST(score * 1000 AS BIGINT)) AS BIGINT)', 'count(score) * 1000', 3)} AS mean_score,
        {sql.ratio('CAST(sum(micros) AS BIGINT)', 'count(*) FILTER (success) * 1000000', 6)} AS cost_per_pass,
        count(*) FILTER (escalated AND score IS NOT NULL) AS n_lifted,
        round(avg(CAST(floor((score - local_score) * 1000 + 0.5) AS BIGINT)) FILTER (escalated) / 1000, 3) AS mean_lift
      FROM dated GROUP BY GROUPING SETS ((source, model, lang), (source, model))),
    begun AS (SELECT * EXCLUDE (begun), min(begun) OVER (PARTITION BY source, model) AS run_began FROM rated)
    SELECT *, lag(source) OVER t AS previous_run, round(pass_rate_pct - lag(pass_rate_pct) OVER t, 3) AS pass_rate_change,
      dense_rank() OVER (PARTITION BY lang, is_total ORDER BY pass_rate_pct DESC NULLS LAST) AS rank_in_category
    FROM begun WINDOW t AS (PARTITION BY model, lang, is_total ORDER BY run_began, source)
    """,
)
def run_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of each model in the order of time, per category and in total."""
    at = F.lit("2025-01-01").cast("timestamp_ntz") - F.make_interval(secs=(7919 * F.col("doc_id") % 100003).cast("decimal(18,6)"))
    model = F.when(F.col("doc_id") % 3 == 0, F.lit("qwen2.5:0.5b")).otherwise(F.lit("qwen2.5:3b"))
    dated = _results(Tables(spark, folder)).withColumns({"model": model, "at": at})
    return report.compare_runs(dated, "source", "model", "lang", "at")


@query(
    "normalise_labels",
    r"""
    SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '^(?:www|m)\.', '') AS host,
      regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS section, count(*) AS n_pages
    FROM pages GROUP BY ALL
    """,
)
def normalise_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Host and section labels of page addresses, made comparable."""
    labelled = Tables(spark, folder).pages.select(
        T.url_host(F.col("url")).alias("host"), T.url_section(F.col("url")).alias("section")
    )
    return labelled.groupBy("host", "section").agg(F.count(F.lit(1)).alias("n_pages"))


def _history_results(t: Tables, category: Column, agent: Column) -> DataFrame:
    return _results(t).select(
        F.col("doc_id").cast("string").alias("task_id"),
        category.alias("category"),
        agent.alias("agent"),
        "success",
        "score",
        F.coalesce("escalated", F.lit(False)).alias("escalated"),
        "local_score",
        "latency_s",
        "cloud_calls",
        "cost_usd",
        "data_kb",
        F.lit("judge (expected)").alias("score_method"),
        F.concat(F.lit("first line\n"), "output").alias("judge_reason"),
    )


def _history_files(t: Tables, spark: SparkSession) -> list[str]:
    """Three runs as files: one early, one current, one of current records below an early header.

    In the third, every tenth record has a score that is no number, and every eleventh an extra field.
    """
    early_label = F.when(F.col("lang") == "en", F.lit("A-File/Log")).otherwise(F.lit("D-Document"))
    label = F.when(F.col("lang") == "en", F.lit("A - File/Log Analysis")).otherwise(F.lit("D - Document Processing"))
    early, current, mixed = (scratch_path(spark, name) for name in ("early", "current", "mixed"))
    first = history.tag_run(_history_results(t, early_label, F.lit("file_agent [LOCAL]")), "hybrid", "qwen2.5:0.5b")
    history.export_csv(first.drop("judge_reason"), early)
    second = history.tag_run(_history_results(t, label, F.lit("file_agent")), "hybrid", "qwen2.5:3b")
    history.export_csv(second, current)
    number = F.col("task_id").cast("bigint")
    texts = {name: F.coalesce(F.col(name).cast("string"), F.lit("")) for name in history.COLUMNS}
    texts["run_time"] = F.date_format("run_time", "yyyy-MM-dd HH:mm:ss")
    texts["score"] = F.when(number % 10 == 0, F.lit("n/a")).otherwise(texts["score"])
    line = F.to_csv(F.struct(*[texts[name].alias(name) for name in history.COLUMNS]), {"escape": '"', "emptyValue": ""})
    line = F.when(number % 11 == 0, F.concat(line, F.lit(",more"))).otherwise(line)
    spark.range(1, numPartitions=1).select(F.lit(",".join(history.EARLY_COLUMNS)).alias("value")).write.text(mixed)
    second.select(line.alias("value")).write.mode("append").text(mixed)
    return [early, current, mixed]


@query(
    "history_scan",
    f"""
    WITH {_SQL_RESULTS},
    copies AS (
      SELECT *, c FROM results, range(3) r(c) WHERE c < 2 OR (doc_id % 10 <> 0 AND doc_id % 11 <> 0))
    SELECT CASE lang WHEN 'en' THEN 'A - File/Log Analysis' ELSE 'D - Document Processing' END AS category,
      'file_agent' AS agent, count(*) AS n_rows, count(success) AS n_scored, count(*) FILTER (success) AS n_passed,
      CAST(sum(micros) AS DOUBLE) / 1000000 AS cost_usd, count(*) FILTER (c > 0) AS n_reasons
    FROM copies GROUP BY ALL
    """,
)
def history_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Runs in the early layout, in the current one, and mixed in one file, read as one history."""
    read = history.read_history(spark, _history_files(Tables(spark, folder), spark))
    return read.groupBy("category", "agent").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("success").alias("n_scored"),
        F.count_if("success").alias("n_passed"),
        F.sum("cost_usd").cast("double").alias("cost_usd"),
        F.count("judge_reason").alias("n_reasons"),
    )


@query(
    "history_quarantine",
    """
    SELECT layout, reason, count(*) AS n_lines, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM (
      SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '17 fields' ELSE 'unreadable value' END AS reason,
        CASE WHEN doc_id % 11 <> 0 THEN 'current' END AS layout
      FROM documents WHERE doc_id % 10 = 0 OR doc_id % 11 = 0) GROUP BY ALL
    """,
)
def history_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the same files that are no record, by reason."""
    lines = history.read_history_lines(spark, _history_files(Tables(spark, folder), spark))
    task = F.get(F.split("line", ","), 3).try_cast("bigint")
    return files.quarantine(lines).groupBy("layout", "reason").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(task).alias("id_sum")
    )


@query(
    "append_results",
    f"""
    WITH {_SQL_RESULTS}
    SELECT s.system, lang AS category, count(*) AS n_rows, count(score) AS n_scores,
      CAST(sum(length(output) + 11) AS BIGINT) AS reason_chars
    FROM results, (VALUES ('hybrid'), ('cloud_only')) s(system) GROUP BY ALL
    """,
)
def append_results(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs appended to the partitioned history table and read back."""
    t = Tables(spark, folder)
    path = scratch_path(spark, "history")
    for system in ("hybrid", "cloud_only"):
        history.append_results(
            history.tag_run(_history_results(t, F.col("lang"), F.lit("file_agent")), system, "qwen2.5:3b"), path
        )
    return history.read_results(spark, path).groupBy("system", "category").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("score").alias("n_scores"),
        F.sum(F.length("judge_reason")).cast("bigint").alias("reason_chars"),
    )
