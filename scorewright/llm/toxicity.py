"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are the density, count and variety of lexicon words, second-person words near
them, second-person words in all, capitals, exclamation and question marks, symbols, obfuscated
lexicon words (digits or signs for letters, masked letters, letters drawn out) and the length. The
lexicon is a fixed list of insults together with the words that the learning rows show to be toxic
(``learn_lexicon``). Trees and calibration are fitted on different learning rows.

Fitting takes a bounded sample: at most about ``TRAIN_ROWS`` labelled rows, picked by hash of doc_id,
in ``TRAIN_PARTS`` partitions.
Scoring is over all rows, whole texts, on the executors.

Rows: one output row per input row. Null and empty texts have all features 0 and are scored like
others. Labels that are null are no labels; a doc_id labelled more than once counts as toxic if any
label says so. Without labelled rows every score is 0; with labels of one class it is that class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.llm.common import map_arrow, utf8
from scorewright.scale import materialize

TRAIN_ROWS = 20_000
TRAIN_PARTS = 4
LEXICON_WORDS = 150
MIN_DOCS = 5
MIN_ODDS = 4.0
NEAR = 3
CACHED_WORDS = 1_000_000
#: Names of columns made while scoring.
USED = ("score", "predicted", "features", "_dense", "_chance", "_score", "rawPrediction", "probability", "prediction")
TREES = 15
DEPTH = 4

# Insults that count without being learned.
INSULTS = frozenset(
    "asshole bastard bitch clown crap cretin damn despicable disgusting dumb dumbass fool freak garbage hate idiot "
    "idiotic idiots imbecile jerk kill loser losers lunatic moron moronic morons nasty pathetic pig retard rubbish "
    "scum scumbag shit shut sick slut stupid suck sucks trash ugly vermin vile worthless".split()
)
# Second-person words of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos ti tus "
    "usted ustedes vosotros".split()
)
# Signs read as letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

PLAIN, HIT, HIDDEN, PERSON = range(4)
N_FEATURES = 12

_EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def bare(word: str) -> str:
    return word.strip(_EDGES)


class WordKinds(dict):
    """Kind of each lower-case word: lexicon word, obfuscated one, second person, or none of them."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self._lexicon = lexicon
        self._masked = {word[:k] + "*" + word[k + 1 :] for word in lexicon if len(word) > 3 for k in range(1, len(word) - 1)}

    def _hidden(self, word: str) -> bool:
        if word in self._masked:
            return True
        read = "".join(SIGNS.get(c, c) for c in word)
        read = bare(read).replace("*", "").replace(".", "").replace("-", "").replace("_", "")
        if read in self._lexicon:
            return True
        return re.sub(r"(.)\1{2,}", r"\1", read) in self._lexicon

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        word = raw.decode()
        core = bare(word)
        if core in self._lexicon:
            kind = HIT
        elif core in SECOND_PERSON:
            kind = PERSON
        elif len(word) > 3 and self._hidden(word):
            kind = HIDDEN
        else:
            kind = PLAIN
        self[raw] = kind
        return kind


def features(text: bytes | None, kinds: WordKinds) -> list[float]:
    text = text or b""
    words = text.lower().split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    found = np.fromiter(map(kinds.__getitem__, words), np.int8, n)
    hits = np.flatnonzero((found == HIT) | (found == HIDDEN))
    persons = np.flatnonzero(found == PERSON)
    near = 0
    if len(hits) and len(persons):
        after = np.searchsorted(persons, hits - NEAR)
        near = int((persons[np.minimum(after, len(persons) - 1)] - hits <= NEAR)[after < len(persons)].sum())
    size = len(text)
    upper = size - len(text.translate(None, _UPPER))
    letters = upper + size - len(text.translate(None, _LOWER))
    marks = text.count(b"!") + text.count(b"?")
    symbols = size - len(text.translate(None, b"#*$%&|<>@"))
    hidden = int((found == HIDDEN).sum())
    return [
        100.0 * len(hits) / n,
        float(np.log1p(len(hits))),
        float(len({words[i] for i in hits.tolist()})),
        100.0 * near / n,
        float(near),
        100.0 * len(persons) / n,
        upper / max(1, letters),
        100.0 * marks / size,
        100.0 * symbols / size,
        100.0 * hidden / n,
        float(np.log1p(hidden)),
        float(np.log1p(n)),
    ]


def with_features(docs: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """``docs`` without its text, with ``features`` (a vector)."""
    others = [name for name in docs.columns if name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = WordKinds(lexicon)
        for batch in batches:
            rows = [features(text, kinds) for text in utf8(batch.column(batch.schema.get_field_index("text")))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in others), pa.array(rows, pa.list_(pa.float64()))], [*others, "_dense"]
            )

    schema = docs.select(others).schema.add("_dense", T.ArrayType(T.DoubleType()))
    return map_arrow(docs, run, schema).withColumn("features", array_to_vector("_dense")).drop("_dense")


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            found = sorted({bare(word.decode()) for word in (text or b"").lower().split()} - {""})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], ["word", "toxic"])


def learn_lexicon(rows: DataFrame, words: int = LEXICON_WORDS) -> frozenset[str]:
    """Words in many more toxic than other rows (toxic, text): by the lower end of the odds ratio."""
    sizes = {row["toxic"]: row["count"] for row in rows.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return INSULTS
    seen = map_arrow(rows.select("toxic", "text"), _words_of, "word string, toxic int")
    counts = seen.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = ((F.col("bad") + 0.5) / sizes[1]) / ((F.col("good") + 0.5) / sizes[0])
    scored = counts.where(F.col("bad") >= MIN_DOCS).select("word", (F.log(odds) - F.sqrt(1 / F.col("bad") + 1 / (F.col("good") + 0.5))).alias("low"))
    best = scored.where(F.col("low") >= float(np.log(MIN_ODDS))).orderBy(F.desc("low"), "word").limit(words)
    return INSULTS | {row["word"] for row in best.collect()}


class Model:
    """Lexicon, trees and calibration; ``rate`` is the score of all rows where nothing could be fitted."""

    def __init__(self, lexicon: frozenset[str], trees=None, curve=None, rate: float = 0.0):
        self.lexicon, self.trees, self.curve, self.rate = lexicon, trees, curve, rate

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` without its text, with ``score`` and ``predicted``; columns of names used on the way are replaced or go."""
        others = [name for name in docs.columns if name not in ("text", *USED)]
        docs = docs.select(*others, "text")
        if self.trees is None:
            scored = docs.select(*others, F.lit(self.rate).alias("score"))
        else:
            raw = self.trees.transform(with_features(docs, self.lexicon))
            raw = raw.select(*others, vector_to_array("probability")[1].alias("_chance"))
            scored = self.curve.transform(raw).select(*others, F.least(F.greatest("_score", F.lit(0.0)), F.lit(1.0)).alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, seed: int = 7) -> Model:
    """A model of documents (doc_id, text) and labels (doc_id, toxic); rows of both may be any number."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = known.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    some = known.where(part < int(min(1.0, rows / max(1, n)) * 1_000_000)).limit(2 * rows)
    # At most 2 * rows short rows: small enough to broadcast.
    texts = materialize(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "labelled")
    sizes = {row["toxic"]: row["count"] for row in texts.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(INSULTS, rate=float(sizes.get(1, 0) > 0))
    lexicon = learn_lexicon(texts)
    # The boosting runs a hundred jobs over these few megabytes: few partitions, dealt by doc_id so that reruns agree.
    ready = with_features(texts, lexicon).repartition(TRAIN_PARTS, "doc_id").sortWithinPartitions("doc_id")
    ready = materialize(ready, "features")
    fold = F.crc32(F.concat(F.lit("calibrate"), F.col("doc_id").cast("string"))) % 4 == 0
    trees = GBTClassifier(labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, seed=seed).fit(ready.where(~fold))
    held = trees.transform(ready.where(fold)).select(F.col("toxic").cast("double"), vector_to_array("probability")[1].alias("_chance"))
    if held.select("toxic").distinct().count() < 2:
        held = trees.transform(ready).select(F.col("toxic").cast("double"), vector_to_array("probability")[1].alias("_chance"))
    curve = IsotonicRegression(featuresCol="_chance", labelCol="toxic", predictionCol="_score").fit(held)
    return Model(lexicon, trees, curve)
