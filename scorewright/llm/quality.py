"""Quality rules as a short-circuit cascade.

A document is kept unless a rule rejects it. What a rule costs and how often it rejects is measured
on a bounded sample (``SAMPLE`` documents, picked by hash over all partitions, measured on the
executors); the cascade then asks the rule with the most rejections per second first and stops at the
first rejection. The order changes the time only, never a verdict.

Measures are taken once per document and when a rule asks for them. Words are runs of anything but
ASCII white space. Windows of three words are compared by 64-bit hashes.

Rows: one output row per input row, in which all columns of the input are kept if wanted. A null text
has no words, so it fails the rule on length. Null ids and repeated rows are rows like others.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import map_arrow, utf8
from scorewright.llm.shingles import PLACES, mix

SAMPLE = 2_000

MIN_WORDS = 50
MAX_REPEATED = 50
MAX_SYMBOLS = 20
MAX_DUPLICATE_LINES = 60
MAX_ELLIPSES = 30
MIN_LETTERS = 50
WORD_LENGTHS = (2, 25)

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_TRAIL = bytes(range(0x80, 0xC0))
_LEAD = bytes(range(0xC0, 0x100))


class Measures:
    """What rules ask about one text."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    def _count(self, kinds: bytes) -> int:
        return len(self.text) - len(self.text.translate(None, kinds))

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - self._count(_SPACE) - self._count(_TRAIL)

    @cached_property
    def n_symbols(self) -> int:
        return self._count(_SYMBOLS)

    @cached_property
    def n_upper(self) -> int:
        return self._count(_UPPER)

    @cached_property
    def n_lower(self) -> int:
        return self._count(_LOWER)

    @cached_property
    def n_letters(self) -> int:
        return self.n_upper + self.n_lower + self._count(_LEAD)

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.text.split(b"\n") if not line.isspace() and line]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_ellipses(self) -> int:
        return sum(line.endswith(b"...") for line in self.lines)

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        hashes = np.fromiter(map(hash, self.words), np.int64, n).view(np.uint64)
        windows = mix(hashes[:-2] * PLACES[0] + hashes[1:-1] * PLACES[1] + hashes[2:] * PLACES[2])
        ordered = np.sort(windows)
        repeated = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(repeated):
            return 0
        found = np.isin(windows, repeated)
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= found
        return int(covered.sum())


Rule = Callable[[Measures], bool]


def too_short(m: Measures) -> bool:
    return m.n_words < MIN_WORDS


def repetitive(m: Measures) -> bool:
    return 100 * m.n_repeat_words > MAX_REPEATED * m.n_words


def symbols(m: Measures) -> bool:
    return 100 * m.n_symbols > MAX_SYMBOLS * m.n_words


def capitals(m: Measures) -> bool:
    return m.n_upper > m.n_lower


def few_letters(m: Measures) -> bool:
    return 100 * m.n_letters < MIN_LETTERS * m.word_chars


def word_lengths(m: Measures) -> bool:
    return not WORD_LENGTHS[0] * m.n_words <= m.word_chars <= WORD_LENGTHS[1] * m.n_words


def duplicate_lines(m: Measures) -> bool:
    return 100 * m.n_dup_lines > MAX_DUPLICATE_LINES * m.n_lines


def ellipses(m: Measures) -> bool:
    return 100 * m.n_ellipses > MAX_ELLIPSES * m.n_lines


BASE: tuple[Rule, ...] = (too_short, repetitive)
FURTHER: tuple[Rule, ...] = (symbols, capitals, few_letters, word_lengths, duplicate_lines, ellipses)


def _trial(rules: tuple[Rule, ...]):
    """Seconds and rejections of each rule on its own, over the documents of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for text in utf8(batch.column(0)):
                for k, rule in enumerate(rules):
                    measures = Measures(text)
                    began = time.perf_counter()
                    rejected[k] += bool(rule(measures))
                    seconds[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(rules)), pa.int32()), pa.array(seconds), pa.array(rejected, pa.int64())],
            ["rule", "seconds", "rejected"],
        )

    return run


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], sample: int = SAMPLE) -> tuple[Rule, ...]:
    """The rules by rejections per second on about ``sample`` documents, highest first."""
    n = docs.count()
    share = min(1.0, sample / max(1, n))
    mark = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1_000_000))
    some = docs.where(mark < F.lit(int(share * 1_000_000) + 1)).select("text")
    tried = map_arrow(some, _trial(rules), "rule int, seconds double, rejected bigint")
    found = {row["rule"]: row for row in tried.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()}

    def gain(k: int) -> float:
        return found[k]["rejected"] / max(found[k]["seconds"], 1e-9) if k in found else 0.0

    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain(k), k)))


def assess(docs: DataFrame) -> DataFrame:
    """Base measures and verdict of every document (doc_id, text).

    base_failed: too short or repetitive; kept: not base_failed and no further rule rejects.
    """
    rules = order_rules(docs, FURTHER)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(names) + 2)]
            for text in utf8(batch.column(1)):
                m = Measures(text)
                failed = any(rule(m) for rule in BASE)
                kept = not failed and not any(rule(m) for rule in rules)
                for column, value in zip(columns, [*(getattr(m, name) for name in names), failed, kept]):
                    column.append(value)
            arrays = [pa.array(column, pa.int64()) for column in columns[:-2]] + [pa.array(c, pa.bool_()) for c in columns[-2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names, "base_failed", "kept"])

    schema = f"doc_id bigint, {', '.join(f'{name} bigint' for name in names)}, base_failed boolean, kept boolean"
    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema)


def keep(docs: DataFrame) -> DataFrame:
    """The rows that no rule rejects, with all their columns; base rules are part of the cascade."""
    rules = order_rules(docs, BASE + FURTHER)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text in utf8(batch.column(at)):
                m = Measures(text)
                kept.append(not any(rule(m) for rule in rules))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
