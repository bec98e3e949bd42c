"""Documents: word counts, summaries, outlines, entities, retrieval, classification."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions import text as T
from scorewright.scale import bounded_batches, lookup_join, materialize

# Entity patterns by type. Java and RE2 syntax agree on all of them.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ENTITY_PATTERNS = {
    "date": rf"\b(?:\d{{1,2}} )?(?:{MONTHS}) \d{{4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b",
    "money": r"[£$€]\d+(?:,\d{3})*(?:\.\d+)?",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "organisation": r"(?:[A-Z][A-Za-z&]+ )+(?:Ltd|Inc|LLC|PLC|GmbH|Corp)\b",
}
# What a text must hold for a slow pattern to be worth running.
ENTITY_HINTS = {"date": r"\d{4}", "email": "@"}
# Patterns of HTML headings, paragraphs and tags.
HTML_HEADING = r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1>"
HTML_PARAGRAPH = r"(?is)</h1>.*?<p(?:\s[^>]*)?>(.*?)(?:</p>|<p[\s>]|<h[1-6]|</article>|\z)"
HTML_TAG = r"(?s)<[^>]*>"
# Words of all questions that go to the tasks at once, and passages a task looks at together.
QUESTION_WORDS = 100_000
PASSAGES_AT_ONCE = 256


def word_frequency(docs: DataFrame, text: str) -> DataFrame:
    """Occurrences of each lower-cased word; counted per task before the shuffle."""
    parts = docs.select(F.explode(F.split(F.lower(text), T.NON_WORD)).alias("word"))
    return parts.where(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def extractive_summary(docs: DataFrame, doc_id: str, text: str, *, k: int = 3) -> DataFrame:
    """The ``k`` sentences with the highest mean word frequency inside their document.

    Ties go to the earlier sentence; the summary keeps document order. Texts move once, so that the work
    does not hang on how the files are cut; all else happens inside a row, by sorting the words of its
    document. No word becomes a row, so nothing beyond the texts is shuffled or spilled. Rows that share
    an id are documents of their own.
    """
    placed = docs.select(doc_id, text).repartition(doc_id)

    def summarised(sentences: Column) -> Column:
        def chosen(best: Column) -> Column:
            places = F.array_sort(F.transform(best, lambda b: b["at"]))
            return F.struct(
                F.size(sentences).cast("bigint").alias("n_sentences"),
                F.coalesce(F.size(best), F.lit(0)).cast("bigint").alias("n_chosen"),
                F.coalesce(
                    F.array_join(F.transform(places, lambda at: F.get(sentences, at)), " "), F.lit("")
                ).alias("summary"),
            )

        return _bound(F.slice(F.sort_array(_sentence_scores(sentences)), 1, k), chosen)

    found = placed.select(doc_id, _bound(T.sentences(F.col(text)), summarised).alias("_found"))
    return found.select(doc_id, "_found.n_sentences", "_found.n_chosen", "_found.summary")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: Catalyst copies no argument of a lambda into its body."""
    return F.get(F.transform(F.array(value), body), 0)


def _per_run(items: Column, key: Callable[[Column], Column], value: Callable[[Column, Column, Column], Column]) -> Column:
    """``value`` of each run of neighbours in ``items`` with the same ``key``: of the run, its first item and its size."""

    def cut(held: Column) -> Column:
        def starts(at: Column) -> Column:
            return (at == 0) | ~key(F.get(held, at)).eqNullSafe(key(F.get(held, at - 1)))

        def runs(edges: Column) -> Column:
            def one_run(at: Column, nth: Column) -> Column:
                n = F.get(edges, nth + 1) - at
                return value(F.slice(held, at + 1, n), F.get(held, at), n)

            return F.transform(F.slice(edges, 1, F.size(edges) - 1), one_run)

        # The place behind the last item is an edge too.
        return _bound(F.filter(F.sequence(F.lit(0), F.size(held)), starts), runs)

    return _bound(items, cut)


def _sentence_scores(sentences: Column) -> Column:
    """(-score, at) of each sentence with words; the score is the mean count of its words in all sentences."""
    words = F.flatten(
        F.transform(sentences, lambda s, at: F.transform(T.words(s), lambda w: F.struct(w.alias("word"), at.alias("at"))))
    )

    def counted(run: Column, first: Column, n: Column) -> Column:
        # Place and count in one number: numbers sort faster than rows do.
        return F.transform(run, lambda one: F.shiftleft(one["at"].cast("bigint"), 32).bitwiseOR(n))

    def scored(run: Column, first: Column, n: Column) -> Column:
        total = F.aggregate(run, F.lit(0).cast("bigint"), lambda so_far, one: so_far + one.bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.struct((-total.cast("double") / n).alias("minus"), F.shiftright(first, 32).cast("int").alias("at"))

    counts = F.flatten(_per_run(F.sort_array(words), lambda one: one["word"], counted))
    return _per_run(F.sort_array(counts), lambda one: F.shiftright(one, 32), scored)


def outline_html(pages: DataFrame, html: str) -> DataFrame:
    """Add ``heading`` and ``lead``: the h1 and the first sentence of the paragraph after it."""
    def clean(fragment: Column) -> Column:
        return T.strip(F.regexp_replace(fragment, HTML_TAG, ""))

    lead = clean(F.regexp_extract(F.col(html), HTML_PARAGRAPH, 1))
    return pages.withColumns(
        {
            "heading": clean(F.regexp_extract(F.col(html), HTML_HEADING, 1)),
            "lead": F.coalesce(F.get(T.sentences(lead), 0), F.lit("")),
        }
    )


def outline_text(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Sections of plain text: ``section, heading, lead``.

    A section is a block between blank lines. Its heading is a first line without end mark, of
    any length, above more text, or a ``Label:`` that the text follows; the lead is the first sentence after it.
    """
    blocks = docs.select(doc_id, F.posexplode(F.split(text, r"\n[ \t]*\n\s*")).alias("_at", "_block"))
    own_line = F.regexp_extract("_block", r"\A\s*([^\n]*[^\s.!?:;,])[ \t]*\n", 1)
    label = F.regexp_extract("_block", r"\A\s*(\p{Lu}[\p{L} ]*):\s+\S", 1)
    by_line = (own_line != "") & (label == "")
    heading = F.when(by_line, own_line).when(label != "", label)
    body = F.when(by_line, F.regexp_replace("_block", r"\A\s*[^\n]*\n", "")).otherwise(
        F.regexp_replace("_block", r"\A\s*[^:]*:", "")
    )
    one_line = F.regexp_replace(body, r"\s+", " ")
    return blocks.where(heading.isNotNull()).select(
        doc_id,
        F.col("_at").cast("bigint").alias("section"),
        heading.alias("heading"),
        F.coalesce(F.get(T.sentences(one_line), 0), F.lit("")).alias("lead"),
    )


def entity_lists(
    docs: DataFrame,
    doc_id: str,
    text: str,
    *,
    patterns: Mapping[str, str] = ENTITY_PATTERNS,
    names: Sequence[str] = (),
) -> DataFrame:
    """Distinct entities of each document: ``<doc_id>, entity_type, entity``.

    Types come from patterns. People are found only from the caller's ``names``: there is no
    pattern for them.
    """

    def typed(kind: str, values: Column) -> Column:
        return F.transform(
            F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("entity"))
        )

    def matches(kind: str, pattern: str) -> Column:
        every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        hint = ENTITY_HINTS.get(kind)
        return F.when(F.rlike(F.col(text), F.lit(hint)), every).otherwise(F.array().cast("array<string>")) if hint else every

    found = [typed(kind, matches(kind, pattern)) for kind, pattern in patterns.items()]
    if names:
        listed = F.array(*[F.lit(name) for name in names])
        found.append(typed("person", F.filter(listed, lambda name: F.contains(F.col(text), name))))
    return docs.select(doc_id, F.inline(F.concat(*found)))


def dictionary_entities(
    docs: DataFrame, doc_id: str, text: str, names: DataFrame, *, name: str = "name", kind: str = "person"
) -> DataFrame:
    """Names of a table that occur in a document, as whole words in order: ``<doc_id>, entity_type, entity``.

    Case counts; what lies between the words does not. The table may be of any size: a word of a text is
    first looked up among the first words of names, and only where one begins the following words, as many
    as names with that first word have, are joined with whole names. Both lookups are broadcast where the
    table is small and shuffled, with hot words spread, where it is not. A place carries as many words as the
    longest name has.
    """

    def plain(column: str) -> Column:
        return F.filter(F.split(F.col(column), T.NON_WORD), lambda word: word != "")

    listed = names.select(F.col(name).alias("entity"), plain(name).alias("_words")).where(F.size("_words") > 0).distinct()
    listed = materialize(listed.withColumn("_name", F.array_join("_words", " ")), "names")
    longest = listed.agg(F.coalesce(F.max(F.size("_words")), F.lit(1))).first()[0]
    firsts = listed.groupBy(F.get("_words", 0).alias("_first")).agg(F.collect_set(F.size("_words")).alias("_lengths"))

    worded = docs.select(doc_id, plain(text).alias("_all"))
    ahead = F.transform("_all", lambda word, at: F.struct(word.alias("_first"), F.slice("_all", at + 1, F.lit(longest)).alias("_ahead")))
    places = worded.select(doc_id, F.inline(ahead))
    begun = lookup_join(places, firsts, ["_first"], spread=[doc_id, "_ahead"], how="inner")
    cut = F.filter("_lengths", lambda n: n <= F.size("_ahead"))
    runs = F.transform(cut, lambda n: F.array_join(F.slice("_ahead", F.lit(1), n), " "))
    found = begun.select(doc_id, F.explode(runs).alias("_name")).distinct()
    whole = lookup_join(found, listed.select("_name", "entity"), ["_name"], spread=[doc_id], how="inner", stored=True)
    return whole.select(doc_id, F.lit(kind).alias("entity_type"), "entity").distinct()


def count_entities(entities: DataFrame) -> DataFrame:
    """Number of documents per entity."""
    return entities.groupBy("entity_type", "entity").agg(F.count(F.lit(1)).alias("n_docs"))


def retrieve_passages(
    questions: DataFrame,
    question_id: str,
    passages: DataFrame,
    passage_id: str,
    text: str,
    *,
    k: int = 3,
    block_words: int = QUESTION_WORDS,
) -> DataFrame:
    """The ``k`` passages that share most distinct words with each question; ties by passage id, NULL last.

    Scores are the same whether words are rare or common, and common ones bring nearly every passage to
    nearly every question. So no pair of a question and a passage is a row. The questions are the stated
    set: their words go to all tasks, in blocks of about ``block_words`` words, and a task goes through its
    passages once per block and adds up shared words for all questions of the block at once. It keeps the best
    ``k`` passages of each question; a passage with fewer asked words than the ``k``-th of them has, is
    not looked at further. What is shuffled is at most ``k`` rows per task and question.

    Questions with the same words are worked on once.
    """
    spark = passages.sparkSession
    bounded_batches(spark)
    listed = questions.select(
        question_id, F.array_sort(F.array_distinct(T.words(F.col(text)))).alias("_texts")
    ).where(F.size("_texts") > 0)
    asked = listed.select("_texts").distinct().withColumn("_question", F.monotonically_increasing_id())
    asked = materialize(asked, "asked")
    total = asked.agg(F.coalesce(F.sum(F.size("_texts")), F.lit(0))).first()[0]
    blocks = -(-max(1, total) // block_words)
    worded = passages.select(passage_id, F.split(F.lower(text), T.NON_WORD).alias("_words"))
    kind = worded.schema[passage_id].dataType.simpleString()
    schema = f"_question BIGINT, {passage_id} {kind}, n_shared BIGINT"

    answers = spark.createDataFrame([], schema)
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("_question"), F.lit(blocks)) == block).collect()  # block_words words or so
        if held:
            postings = spark.sparkContext.broadcast([(row["_question"], row["_texts"]) for row in held])
            answers = answers.unionAll(worded.mapInArrow(_best_of_task(postings, k), schema))
    order = Window.partitionBy("_question").orderBy(F.desc("n_shared"), F.asc_nulls_last(passage_id))
    best = answers.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    keyed = lookup_join(listed, asked, ["_texts"], spread=[question_id], how="inner", stored=True)
    return lookup_join(keyed.select(question_id, "_question"), best, ["_question"], spread=[question_id], how="inner").drop(
        "_question"
    )


def _best_of_task(asked, k: int):
    """A task's best ``k`` passages per question, from batches of (passage id, words)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [number for number, _ in asked.value]
        postings: dict[str, list[int]] = {}
        for place, (_, words) in enumerate(asked.value):
            for word in words:
                postings.setdefault(word, []).append(place)
        known = {word: number for number, word in enumerate(postings)}
        sizes = np.array([len(places) for places in postings.values()], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        places = np.concatenate([np.array(held, np.int64) for held in postings.values()])
        found: list[list[tuple]] = [[] for _ in names]
        least = np.ones(len(names), np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0)
            for start in range(0, len(batch), PASSAGES_AT_ONCE):
                part = batch.slice(start, PASSAGES_AT_ONCE)
                shared = _shared_words(part.column(1), known, starts, places, len(names))
                if not (shared >= least).any():
                    continue
                ids = part.column(0).to_pylist()
                for row, place in np.argwhere(shared >= least).tolist():
                    found[place].append((-int(shared[row, place]), ids[row] is None, ids[row]))
                for place in np.flatnonzero((shared >= least).any(axis=0)).tolist():
                    kept = found[place] = heapq.nsmallest(k, found[place], key=lambda one: (one[0], one[1], one[2] or 0))
                    if len(kept) == k:
                        least[place] = -kept[-1][0]
        if kind is not None:
            rows = [(names[place], name, -score) for place, kept in enumerate(found) for score, _, name in kept]
            columns = list(zip(*rows)) or [(), (), ()]
            arrays = [pa.array(list(column), type_) for column, type_ in zip(columns, [pa.int64(), kind.type, pa.int64()])]
            yield pa.RecordBatch.from_arrays(arrays, ["_question", kind.name, "n_shared"])

    return best


def _shared_words(words: pa.Array, known: dict[str, int], starts: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """How many distinct words each passage (row) shares with each of ``n`` questions (column).

    ``known`` numbers the asked words; the questions that ask for word w are ``places[starts[w]:starts[w + 1]]``.
    """
    coded = words.flatten().dictionary_encode()
    number = np.array([known.get(word, -1) for word in coded.dictionary.to_pylist()] or [-1], np.int64)
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(words)), lengths)
    held = number[coded.indices.to_numpy(zero_copy_only=False)]
    pairs = np.unique((rows * len(known) + held)[held >= 0])
    row, word = np.divmod(pairs, len(known))
    times = starts[word + 1] - starts[word]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    asking = places[np.repeat(starts[word], times) + within]
    return np.bincount(np.repeat(row, times) * n + asking, minlength=len(words) * n).reshape(len(words), n)


def classify(docs: DataFrame, text: str, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add ``predicted``: the label most of whose words occur; ties alphabetical, else ``unknown``.

    Votes are counted inside each row, so nothing is shuffled.
    """
    names = sorted(labels)
    voting = sorted({word for words in labels.values() for word in words})

    def votes(label: str) -> Column:
        return F.size(F.filter("_words", lambda word: word.isin(*labels[label])))

    # One pass over all words leaves the few that vote.
    few = F.filter(F.split(F.lower(text), T.NON_WORD), lambda word: word.isin(*voting))
    counted = docs.withColumn("_words", few).withColumns(
        {f"_votes_{i}": votes(name) for i, name in enumerate(names)}
    )
    most = F.greatest(*[F.col(f"_votes_{i}") for i in range(len(names))]) if len(names) > 1 else F.col("_votes_0")
    predicted = F.when(F.coalesce(most, F.lit(0)) <= 0, F.lit("unknown"))
    for i, name in enumerate(names):
        predicted = predicted.when(F.col(f"_votes_{i}") == most, F.lit(name))
    return counted.withColumn("predicted", predicted).drop("_words", *[f"_votes_{i}" for i in range(len(names))])


def confusion(classified: DataFrame, truth: str) -> DataFrame:
    """Documents per true and predicted label."""
    return classified.groupBy(truth, "predicted").agg(F.count(F.lit(1)).alias("n_docs"))


def extract_code(answers: DataFrame, raw: str) -> DataFrame:
    """Add ``code``, the first fenced block with plain quotes, and the ``tag`` of its fence."""
    return answers.withColumns(
        {"code": T.plain_quotes(T.first_code_block(F.col(raw))), "tag": T.fence_tag(F.col(raw))}
    )


def normalise_quotes(answers: DataFrame, raw: str) -> DataFrame:
    """Add ``plain``, the text with ASCII quotes, and whether that ``changed`` it."""
    plain = T.plain_quotes(F.col(raw))
    return answers.withColumns({"plain": plain, "changed": plain != F.col(raw)})
