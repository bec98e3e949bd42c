"""The registered queries of this package, each over its whole table, and SQL where there is such."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import (
    centroids,
    decontaminate,
    language_id,
    lexical_search,
    license_scan,
    mixing,
    parity_join,
    quality,
    secret_scan,
    simhash,
    token_store,
    toxicity,
    wrapper_html,
)
from scorewright.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

END_ID = 1


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def vocabulary() -> str:
    """Place of the public vocabulary; it is installed on every machine and not part of this package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op9_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written as byte planes and read back."""
    return token_store.store(table(spark, folder, "documents"), vocabulary(), end_id=END_ID).drop("ids")


@query
def op10_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return parity_join.join_near(table(spark, folder, "documents"))[0]


ORACLES["op10_parity_join"] = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS t FROM sets),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM items a JOIN items b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  WITH RECURSIVE r(node, label) AS (
    SELECT doc_id, doc_id FROM sizes
    UNION
    SELECT y, label FROM r JOIN both_ways ON node = x WHERE label < y)
  SELECT node, min(label) AS label FROM r GROUP BY node)
SELECT doc_id, n AS n_shingles, label AS component_id FROM sizes JOIN reach ON node = doc_id
"""


@query
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = decontaminate.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op2_decontaminate"] = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS t
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k),
found AS (
  SELECT doc_id, i, p.k, item_id FROM places p JOIN windows v ON p.k = v.k AND array_to_string(w[i:i + p.k - 1], ' ') = t),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query
def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3, repeating."""
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op5_mix_sources"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM docs GROUP BY source),
total AS (SELECT coalesce(sum(s), 0)::BIGINT AS n FROM sources),
caps AS (
  SELECT source, s, w, row_number() OVER by_level AS k,
    coalesce(sum(3 * s) OVER (by_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_before,
    sum(w) OVER (by_level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS w_left
  FROM sources WINDOW by_level AS (ORDER BY 3 * s / w, source)),
level AS (
  SELECT n - full_before AS rest, w_left FROM caps, total WHERE (n - full_before) * w / w_left <= 3 * s ORDER BY k LIMIT 1),
targets AS (
  SELECT source, s, least((3 * s)::DOUBLE, coalesce((SELECT rest * w / w_left FROM level), (3 * s)::DOUBLE)) AS target FROM sources),
plan AS (
  SELECT source, s, target, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT d.doc_id, d.size, p.s, p.target, p.whole, p.target - p.whole * p.s AS want,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, s AS source_size, target,
  ((whole + CASE WHEN want > 0 AND upto - size / 2 <= want THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base measures and the verdict of all documents."""
    return quality.assess(table(spark, folder, "documents"))


ORACLES["op4_quality_rules"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x
  FROM docs WHERE len(w) >= 3),
often AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
covered AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM often) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(lines, lambda x: x LIKE '%...')) AS n_ellipses,
    len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[a-z]')) AS n_lower,
    len(regexp_extract_all(t, '[^\x00-\x7F]')) AS n_other
  FROM docs LEFT JOIN covered c USING (r)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 20 * n_words OR n_upper > n_lower OR 100 * (n_upper + n_lower + n_other) < 50 * word_chars
    OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 100 * n_dup_lines > 60 * n_lines OR 100 * n_ellipses > 30 * n_lines) AS kept
FROM base
"""


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents, learned from those of three of four folds."""
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out).select("lang", "text"))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


@query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.scan(table(spark, folder, "documents"))


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of four of five folds."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels").where(~held_out).select("doc_id", "toxic"))
    return model.score(docs.select("doc_id", held_out.alias("held_out"), "text"))


@query
def op6_wrapper_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return wrapper_html.main_texts(table(spark, folder, "pages"))


@query
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences named in all documents."""
    found = license_scan.scan_licenses(table(spark, folder, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("licenses", ",").alias("licenses"))


def _license_sql() -> str:
    """The rules as a list, folded over the sequence: what is left of it, and the licences found."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    forms = {license_scan.normal(sentence): name for name, sentence in license_scan.SENTENCES.items()}
    pairs = ", ".join(f"{text(form)}: {text(name)}" for form, name in forms.items())
    rules = ", ".join(
        "{'rest': '', 'part': " + text("|" + "||".join(part) + "|") + ", 'found': [" + text(licence) + "]}"
        for licence, part in license_scan.RULES
    )

    def names(cut: str) -> str:
        lowered = "translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        form = f"trim(regexp_replace({lowered}, '[^a-z0-9]+', ' ', 'g'))"
        return f"list_filter(list_transform(regexp_split_to_array(t, {text(cut)}), lambda part: forms[{form}]), lambda x: x IS NOT NULL)"

    def found(side: str) -> str:
        start = "{'rest': '|' || array_to_string(list_transform(" + side + ", lambda x: x || '|'), '|'), 'part': '', 'found': []::VARCHAR[]}"
        step = "{'rest': replace(s.rest, rule.part, '|*|'), 'part': '', 'found': list_concat(s.found, rule.found)}"
        return f"list_reduce(list_concat([{start}], rules), lambda s, rule: CASE WHEN contains(s.rest, rule.part) THEN {step} ELSE s END).found"

    return f"""
WITH fixed AS (SELECT MAP {{{pairs}}} AS forms, [{rules}] AS rules),
known AS (
  SELECT doc_id, {names(license_scan.LINES)} AS a, {names(license_scan.PARAGRAPHS)} AS b, rules
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), fixed)
SELECT doc_id, len(a)::BIGINT AS n_sentences,
  CASE WHEN len(a) + len(b) = 0 THEN '' ELSE coalesce(array_to_string(list_sort(list_distinct(list_concat({found("a")}, {found("b")}))), ','), '') END AS licenses
FROM known
"""


ORACLES["op1_license_scan"] = _license_sql()


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op11_ranked_search"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w
  FROM benchmark),
asked AS (SELECT q, item_id, unnest(w) AS t FROM items),
total AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM docs WHERE len(w) > 0),
tf AS (
  SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM docs)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * total.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t, total.n),
scores AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * tf.n * total.n) // total.l))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t), total GROUP BY q, item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""


@query
def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and the groups they form within two bits."""
    return simhash.group_near(table(spark, folder, "documents"))


@query
def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Ten rounds of eight centroids over all usable vectors."""
    assigned, last = centroids.cluster(table(spark, folder, "embeddings"))
    return centroids.with_inertia(assigned, last)


def _clusters_sql() -> str:
    """The rounds as a chain of tables."""
    assign = """
a{k} AS MATERIALIZED (
  SELECT r, arg_min(c, [d, c]) AS c, min(d) AS d FROM (
    SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d FROM kept, m{k}) GROUP BY r)"""
    move = """
s{n} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (
  SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM kept JOIN a{k} USING (r)) GROUP BY c, i),
m{n} AS MATERIALIZED (
  SELECT c, coalesce(x, m) AS m FROM m{k} LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{n} GROUP BY c) USING (c))"""
    chain = ",".join(assign.format(k=k) + "," + move.format(k=k, n=k + 1) for k in range(10)) + "," + assign.format(k=10)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT v, sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept)
  ORDER BY h, v LIMIT 8),
{chain},
inertia AS (SELECT c, sum(d)::BIGINT AS ci FROM a10 GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, ci AS cluster_inertia, (SELECT sum(ci)::BIGINT FROM inertia) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM kept JOIN a10 USING (r) JOIN inertia USING (c) JOIN m10 USING (c)
"""


ORACLES["op13_centroid_clustering"] = _clusters_sql()
