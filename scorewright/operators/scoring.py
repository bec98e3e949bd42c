"""Scores for answers: heuristic, recorded judgement, reference similarity, term coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright import schemas
from scorewright.functions import numbers as N
from scorewright.functions import text as T
from scorewright.scale import LITERAL_ROWS, lookup_join

# How a score came about.
TOO_SHORT = "heuristic (output too short)"
NON_EMPTY = "heuristic (non-empty)"
KEYWORD_MATCH = "heuristic (keyword match)"
NO_OUTPUT = "no output"


def term_list(key: Column, terms: Mapping[str, Sequence[str]]) -> Column:
    """The caller's terms for a key as an array, NULL for other keys.

    The lists are one map literal, so nothing is joined or shipped. For more than a few hundred keys use
    :func:`with_terms`.
    """
    if not terms:
        return F.lit(None).cast("array<string>")
    entries = []
    for name, words in terms.items():
        entries += [F.lit(name), F.array(*[F.lit(w) for w in words]).cast("array<string>")]
    return F.try_element_at(F.create_map(*entries), key)


def with_terms(
    rows: DataFrame, key: str, terms: Mapping[str, Sequence[str]] | DataFrame, name: str, *, spread: Sequence[str]
) -> DataFrame:
    """Add the terms of each row's ``key`` as the array ``name``, NULL for other keys.

    A table of terms has the columns ``key`` and ``terms`` (array) and any number of rows; several rows
    of one key are taken together, rows without key or terms count for nothing. It is joined by a
    size-checked lookup, as is a mapping of more than ``LITERAL_ROWS`` keys; a smaller one stays in the plan.
    """
    if isinstance(terms, Mapping):
        if len(terms) <= LITERAL_ROWS:
            return rows.withColumn(name, term_list(F.col(key), terms))
        listed = [(k, list(words)) for k, words in terms.items()]
        terms = rows.sparkSession.createDataFrame(listed, "key string, terms array<string>")
    known = terms.where("key IS NOT NULL AND terms IS NOT NULL").groupBy(F.col("key").alias(key))
    table = known.agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias(name))
    return lookup_join(rows, table, [key], spread=spread)


def heuristic_verdict(
    output: Column,
    keywords: Column,
    *,
    min_chars: int = schemas.MIN_ANSWER_CHARS,
    min_plain_chars: int = schemas.MIN_PLAIN_ANSWER_CHARS,
) -> tuple[Column, Column]:
    """(passed, method): too short fails; without keywords the length decides; else any keyword."""
    n_chars = F.length(T.strip(F.coalesce(output, F.lit(""))))
    short = n_chars < min_chars
    plain = keywords.isNull() | (F.size(keywords) == 0)
    passed = F.when(short, F.lit(False)).when(plain, n_chars > min_plain_chars).otherwise(T.contains_any(output, keywords))
    method = F.when(short, F.lit(TOO_SHORT)).when(plain, F.lit(NON_EMPTY)).otherwise(F.lit(KEYWORD_MATCH))
    return passed, method


def heuristic_score(answers: DataFrame, output: str, keywords: Column, **lengths: int) -> DataFrame:
    """Add ``passed`` and ``score_method`` by the keyword rule."""
    passed, method = heuristic_verdict(F.col(output), keywords, **lengths)
    return answers.withColumns({"passed": passed, "score_method": method})


def judge_inputs(answers: DataFrame, ids: Sequence[str] = ("task_id", "model")) -> DataFrame:
    """What a judge gets to see of each answer it has to score: ``criteria, input, actual_output, expected_output``.

    The expected output is shown in the mode ``expected`` only: a task scored by criteria alone has no single
    right answer, and the judge must not hold one against it. Answers of code tasks, blank ones, and those
    of tasks without criteria are no case for a judge (see :func:`judge_gate`) and are left out.
    """
    mode = F.coalesce("scoring_mode", F.lit("expected"))
    cases = answers.where((mode != "execution") & (F.coalesce("criteria", F.lit("")) != "") & ~T.is_blank(F.col("output")))
    return cases.select(
        *ids,
        "criteria",
        F.col("description").alias("input"),
        F.col("output").alias("actual_output"),
        F.when(mode == "expected", F.col("expected_output")).alias("expected_output"),
    )


def judge_gate(
    answers: DataFrame,
    *,
    output: Column,
    criteria: Column,
    raw_score: Column,
    reason: Column | None = None,
    mode: Column | None = None,
    threshold: float = schemas.PASS_THRESHOLD,
) -> DataFrame:
    """Turn a recorded judge score into ``raw_score, score, passed, judge_reason``.

    Without criteria there is no score; blank output scores 0.0 and fails. The pass test uses the
    raw score, the stored score has three places. ``mode`` is the scoring mode: code tasks have no judge.
    """
    by_code = F.lit(False) if mode is None else F.coalesce(mode == "execution", F.lit(False))
    no_criteria = criteria.isNull() | (criteria == "")
    blank = T.is_blank(output)
    raw = F.when(by_code | no_criteria, F.lit(None).cast("double")).when(blank, F.lit(0.0)).otherwise(raw_score)
    why = F.when(by_code, F.lit(None).cast("string")).when(no_criteria, F.lit("no criteria")).when(blank, F.lit(NO_OUTPUT)).otherwise(
        reason if reason is not None else F.lit(None).cast("string")
    )
    return answers.withColumns(
        {
            "raw_score": raw,
            "score": N.half_up(raw, 3),
            "passed": raw >= F.lit(threshold),
            "judge_reason": why,
        }
    )


def dispatch(
    answers: DataFrame,
    *,
    mode: Column,
    output: Column,
    keywords: Column,
    executes: Column,
    judged: Column,
    threshold: float = schemas.PASS_THRESHOLD,
) -> DataFrame:
    """Add ``success, score, score_method`` by the scoring mode of each row.

    ``execution`` takes the ``executes`` verdict; the other modes take the ``judged`` raw score;
    where that is missing the heuristic decides and the score stays NULL.
    """
    by_rule, rule = heuristic_verdict(output, keywords)
    by_code = mode == "execution"
    has_score = ~by_code & judged.isNotNull()
    method = (
        F.when(by_code, F.lit("automated (syntax check)"))
        .when(has_score, F.concat(F.lit("judge ("), mode, F.lit(")")))
        .otherwise(rule)
    )
    return answers.withColumns(
        {
            "success": F.when(by_code, executes).when(has_score, judged >= F.lit(threshold)).otherwise(by_rule),
            "score": F.when(has_score, N.half_up(judged, 3)),
            "score_method": method,
        }
    )


def token_f1(pairs: DataFrame, ids: Sequence[str], sides: Mapping[str, str], reference: str) -> DataFrame:
    """F1 of word multisets between each answer column and the reference column.

    ``sides`` maps result name -> answer column. Each result comes as ``<name>_overlap``,
    ``<name>_size`` (words of both sides together), ``<name>_raw`` and ``<name>`` (three places).
    A missing answer has NULL results, a blank one scores 0.0.

    All sides share one explode and one count per (row, word), combined before the shuffle. An
    empty word marks which sides are there, so rows without any word need no join to come back.
    """
    columns = {"_ref": reference, **sides}

    def tag(side: str, source: str) -> Column:
        present = F.array_append(T.words(F.col(source)), F.lit(""))
        return F.struct(F.lit(side).alias("side"), F.coalesce(present, F.array(F.lit(""))).alias("words"), F.col(source).isNotNull().alias("there"))

    # Two explodes: no word needs a struct of its own. What is not there has an empty word of no side.
    tagged = pairs.select(*ids, F.inline(F.array(*[tag(side, source) for side, source in columns.items()])))
    exploded = tagged.select(*ids, F.when(F.col("there"), F.col("side")).otherwise(F.lit("")).alias("side"), F.explode("words").alias("word"))
    counts = exploded.groupBy(*ids, "word").agg(
        *[F.count(F.when(F.col("side") == side, F.lit(1))).alias(f"_n_{side}") for side in columns]
    )
    is_word = F.col("word") != ""
    totals = counts.groupBy(*ids).agg(
        *[F.sum(F.when(is_word, F.least("_n__ref", f"_n_{side}"))).alias(f"_overlap_{side}") for side in sides],
        *[F.sum(F.when(is_word, F.col("_n__ref") + F.col(f"_n_{side}"))).alias(f"_size_{side}") for side in sides],
        *[F.max(F.when(~is_word, F.col(f"_n_{side}"))).alias(f"_has_{side}") for side in sides],
    )
    out: list[Column] = [F.col(name) for name in ids]
    zero = F.lit(0).cast("bigint")
    for side in sides:
        overlap = F.coalesce(F.col(f"_overlap_{side}"), zero)
        size = F.coalesce(F.col(f"_size_{side}"), zero)
        has = F.col(f"_has_{side}") > 0
        raw = F.when(size > 0, (overlap * 2).cast("double") / size).otherwise(F.lit(0.0))
        rounded = F.when(size > 0, N.ratio(overlap * 2, size, 3)).otherwise(F.lit(0.0))
        out += [
            F.when(has, overlap).alias(f"{side}_overlap"),
            F.when(has, size).alias(f"{side}_size"),
            F.when(has, raw).alias(f"{side}_raw"),
            F.when(has, rounded).alias(side),
        ]
    return totals.select(*out)


def coverage(answers: DataFrame, output: str, terms: Column) -> DataFrame:
    """Add ``n_terms, n_present, coverage``: share of the required terms found in the answer."""
    found = T.count_contained(F.coalesce(F.col(output), F.lit("")), terms).cast("bigint")
    needed = F.size(terms).cast("bigint")
    return answers.withColumns(
        {
            "n_terms": F.coalesce(needed, F.lit(0).cast("bigint")),
            "n_present": F.when(terms.isNotNull(), found),
            "coverage": F.when(terms.isNotNull(), N.ratio(found, needed, 3)),
        }
    )
