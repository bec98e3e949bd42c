"""Document operators bound to ``documents``, ``pages`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import text as T
from scorewright.operators import text as ops
from scorewright.plans import sql
from scorewright.plans.registry import Tables, query

# Frequent function words per language.
STOP_WORDS = {
    "de": ["der", "die", "und", "das", "ist", "nicht", "von", "zu", "den", "mit"],
    "en": ["the", "of", "and", "to", "in", "that", "with", "for", "is", "was"],
    "es": ["el", "los", "las", "que", "y", "para", "una", "por", "del", "con"],
    "fr": ["le", "la", "les", "et", "des", "du", "une", "pour", "dans", "qui"],
}


@query(
    "word_frequency",
    f"SELECT word, count(*) AS n FROM (SELECT unnest({sql.words('text')}) AS word FROM documents) GROUP BY word",
)
def word_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of each word."""
    return ops.word_frequency(Tables(spark, folder).documents, "text")


@query(
    "extractive_summary",
    f"""
    WITH base AS (SELECT doc_id, {sql.sentences('text')} AS ss FROM documents),
    s AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS pos FROM base),
    tokens AS (SELECT doc_id, pos, unnest({sql.words('sentence')}) AS w FROM s),
    tf AS (SELECT doc_id, w, count(*) AS tf FROM tokens GROUP BY ALL),
    scored AS (SELECT doc_id, pos, CAST(sum(tf) AS DOUBLE) / count(*) AS score FROM tokens JOIN tf USING (doc_id, w) GROUP BY ALL),
    best AS (SELECT doc_id, pos FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) <= 3),
    chosen AS (SELECT doc_id, count(*) AS n, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM best JOIN s USING (doc_id, pos) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, coalesce(n, 0) AS n_chosen, md5(coalesce(summary, '')) AS summary_md5
    FROM base LEFT JOIN chosen USING (doc_id)
    """,
)
def extractive_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Three sentences per document."""
    summaries = ops.extractive_summary(Tables(spark, folder).documents, "doc_id", "text", k=3)
    return summaries.select("doc_id", "n_sentences", "n_chosen", F.md5("summary").alias("summary_md5"))


@query(
    "outline",
    rf"""
    WITH raw AS (
      SELECT page_id, {sql.strip(r"regexp_replace(regexp_extract(html, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g')")} AS heading,
        {sql.strip(r"regexp_replace(regexp_extract(html, '(?is)</h1>.*?<p(?:\s[^>]*)?>(.*?)(?:</p>|<p[\s>]|<h[1-6]|</article>|\z)', 1), '(?s)<[^>]*>', '', 'g')")} AS body
      FROM pages)
    SELECT page_id, heading, coalesce({sql.sentences('body')}[1], '') AS lead FROM raw
    """,
)
def outline(spark: SparkSession, folder: str) -> DataFrame:
    """Heading and first sentence of each page."""
    return ops.outline_html(Tables(spark, folder).pages, "html").select("page_id", "heading", "lead")


@query(
    "document_outline",
    rf"""
    WITH blocks AS (
      SELECT doc_id, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS section
      FROM (SELECT doc_id, regexp_split_to_array('Part ' || lang || chr(10) || replace(text, '. ', '.' || chr(10) || chr(10)), '\n[ \t]*\n\s*') AS b FROM documents)),
    parts AS (
      SELECT doc_id, section, block, regexp_extract(block, '\A\s*([^\n]*[^\s.!?:;,])[ \t]*\n', 1) AS own,
        regexp_extract(block, '\A\s*(\p{{Lu}}[\p{{L}} ]*):\s+\S', 1) AS label FROM blocks),
    bodies AS (
      SELECT doc_id, section, CASE WHEN own <> '' AND label = '' THEN own WHEN label <> '' THEN label END AS heading,
        regexp_replace(CASE WHEN own <> '' AND label = '' THEN regexp_replace(block, '\A\s*[^\n]*\n', '')
          ELSE regexp_replace(block, '\A\s*[^:]*:', '') END, '[\t\n\x0b\f\r ]+', ' ', 'g') AS body FROM parts)
    SELECT doc_id, CAST(section AS BIGINT) AS section, heading, coalesce({sql.sentences('body')}[1], '') AS lead FROM bodies WHERE heading IS NOT NULL
    """,
)
def document_outline(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of each document, set apart by blank lines after sentences."""
    spaced = F.concat(F.lit("Part "), F.col("lang"), F.lit("\n"), F.replace("text", F.lit(". "), F.lit(".\n\n")))
    docs = Tables(spark, folder).documents.select("doc_id", spaced.alias("text"))
    return ops.outline_text(docs, "doc_id", "text")


def _sql_entities() -> str:
    parts = [
        f"SELECT doc_id, '{kind}' AS entity_type, unnest(list_distinct(regexp_extract_all(text, '{pattern}'))) AS entity FROM documents"
        for kind, pattern in ops.ENTITY_PATTERNS.items()
    ]
    return " UNION ALL ".join(parts)


@query("entity_lists", _sql_entities())
def entity_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct dates, amounts, addresses and organisations of each document."""
    return ops.entity_lists(Tables(spark, folder).documents, "doc_id", "text")


@query("entity_counts", f"SELECT entity_type, entity, count(*) AS n_docs FROM ({_sql_entities()}) GROUP BY ALL")
def entity_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per entity."""
    return ops.count_entities(ops.entity_lists(Tables(spark, folder).documents, "doc_id", "text"))


_TOKENS = r"list_filter(regexp_split_to_array({}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query(
    "dictionary_entities",
    f"""
    WITH asked AS (SELECT {_TOKENS.format('text')} AS w FROM benchmark),
    names AS (
      SELECT DISTINCT array_to_string(w[a:b], ' ') AS entity, b - a + 1 AS n FROM asked, (VALUES (1, 1), (1, 2), (2, 4)) v(a, b) WHERE len(w) >= b),
    docs AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents),
    places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
    runs AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS run FROM places, (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(w))
    SELECT DISTINCT doc_id, 'name' AS entity_type, entity FROM runs JOIN names ON run = entity
    """,
)
def dictionary_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Names of one to three words from a table, found in the documents; runs of words of the benchmark stand in for names."""
    t = Tables(spark, folder)
    asked = t.benchmark.select(F.filter(F.split("text", T.NON_WORD), lambda word: word != "").alias("words"))
    runs = F.array(*[F.when(F.size("words") >= b, F.array_join(F.slice("words", a, b - a + 1), " ")) for a, b in ((1, 1), (1, 2), (2, 4))])
    names = asked.select(F.explode(runs).alias("name")).where(F.col("name").isNotNull())
    return ops.dictionary_entities(t.documents, "doc_id", "text", names, kind="name")


@query(
    "passage_retrieval",
    f"""
    WITH q AS (SELECT item_id, unnest(list_distinct({sql.words('text')})) AS w FROM benchmark),
    p AS (SELECT doc_id, unnest(list_distinct({sql.words('text')})) AS w FROM documents),
    scored AS (SELECT item_id, doc_id, count(*) AS n_shared FROM q JOIN p USING (w) GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_shared DESC, doc_id) AS rank FROM scored QUALIFY rank <= 3
    """,
)
def passage_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """Three documents per question, by shared words."""
    t = Tables(spark, folder)
    found = ops.retrieve_passages(
        t.benchmark, "item_id", t.documents.select("doc_id", "text"), "doc_id", "text", k=3
    )
    return found.select("item_id", "doc_id", "n_shared", "rank")


def _sql_votes() -> str:
    columns = []
    for lang, words in sorted(STOP_WORDS.items()):
        literal = "[" + ", ".join(f"'{w}'" for w in words) + "]"
        columns.append(f"len(list_filter(ws, lambda w: list_contains({literal}, w))) AS {lang}")
    cases = " ".join(f"WHEN {lang}_n = most THEN '{lang}'" for lang in sorted(STOP_WORDS))
    return f"""
    WITH w AS (SELECT doc_id, lang, {sql.words('text')} AS ws FROM documents),
    v AS (SELECT doc_id, lang, {', '.join(c + '_n' for c in columns)} FROM w),
    m AS (SELECT *, greatest({', '.join(f'{lang}_n' for lang in sorted(STOP_WORDS))}) AS most FROM v)
    SELECT lang, CASE WHEN most = 0 THEN 'unknown' {cases} END AS predicted, count(*) AS n_docs FROM m GROUP BY ALL
    """


@query("classify_documents", _sql_votes())
def classify_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Language by function words against the true language."""
    docs = Tables(spark, folder).documents.select("lang", "text")
    return ops.confusion(ops.classify(docs, "text", STOP_WORDS), "lang")
