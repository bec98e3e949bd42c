"""Language identification by prediction by partial matching over bytes.

Each language has a byte context tree of contexts of up to two bytes. In a context, a byte seen there
n times among N bytes of q kinds costs -log2(n / (N + q)) bits; another byte costs the escape,
-log2(q / (N + q)), and what it costs in the next shorter context, where the bytes already seen are
excluded. Below the empty context all bytes are alike. So the code lengths are those of a proper
distribution over the 256 bytes. The statistics are frozen after training: the code length of a text
under a language is a sum over its bytes, each looked up once.

Training counts the byte triples of all learning rows, combined per batch and before the shuffle. A
language's tree has at most 256 ** 3 leaves; the model goes to the workers as one table of 32-bit
floats over the distinct bytes that were seen, and ``MODEL_CELLS`` bounds its size.

Rows: one output row per input row. A text that is null or has no letter is ``und`` with score 0, and
so is every text where nothing was learned. Learning rows with null text or null language teach
nothing. Texts are taken whole; each starts after two line ends. Ties go to the language that is
first in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import map_arrow, utf8

UNKNOWN = "und"
MODEL_CELLS = 400_000_000
START = b"\n\n"
NAMES = ("lang_pred", "score")


def _triples(texts: list[bytes]) -> np.ndarray:
    """Codes of the byte triples that end at each byte of the texts."""
    run = np.frombuffer(START + START.join(texts), np.uint8).astype(np.uint32)
    codes = (run[:-2] << 16) | (run[1:-1] << 8) | run[2:]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + len(START))
    inside = np.ones(len(codes), bool)
    for shift in (1, 2):  # the starts between texts are given, not coded
        inside[ends[:-1] - shift] = False
    return codes[inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            codes, uses = np.unique(_triples(texts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int32)), pa.array(uses.astype(np.int64))],
                ["lang", "code", "uses"],
            )


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(np.broadcast(part, whole).shape), where=whole > 0)


def _predict(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Chances of the next symbol (last axis) from its counts and the chances in the shorter context."""
    seen = counts > 0
    kinds, n = seen.sum(-1, keepdims=True), counts.sum(-1, keepdims=True)
    left = 1 - (seen * shorter).sum(-1, keepdims=True)
    whole = left < 1e-9  # nothing to escape to
    own = _ratio(counts, np.where(whole, n, n + kinds))
    rest = _ratio(kinds, n + kinds) * _ratio(shorter, np.where(whole, 0, left))
    return np.where(n > 0, np.where(seen, own, rest), shorter)


class Model:
    """Frozen statistics: symbols of the bytes, languages, and bits per triple and language."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        self.langs = [lang for lang, _, _ in rows]
        used = np.zeros(256, bool)
        for _, codes, _ in rows:
            for shift in (0, 8, 16):
                used[(codes >> shift) & 255] = True
        size = int(used.sum()) + 1  # the last symbol stands for all other bytes
        if size**3 * len(rows) > MODEL_CELLS:
            raise ValueError(f"{len(rows)} languages over {size} symbols; the model takes at most {MODEL_CELLS} cells")
        self.symbol = np.where(used, np.cumsum(used) - 1, size - 1).astype(np.uint32)
        even = np.full(size, 1 / 256)
        even[-1] = 1 - even[:-1].sum()
        spare = max(1, 256 - int(used.sum()))
        self.size, self.bits = size, np.zeros((len(rows), size**3), np.float32)
        for k, (_, codes, uses) in enumerate(rows):
            a, b, c = (self.symbol[(codes >> shift) & 255] for shift in (16, 8, 0))
            three = np.zeros((size, size, size))
            np.add.at(three, (a, b, c), uses)
            chances = even
            for counts in (three.sum((0, 1)), three.sum(0), three):
                chances = _predict(counts, np.broadcast_to(chances, counts.shape))
            chances[..., -1] /= spare  # one byte of those that share the last symbol
            self.bits[k] = -np.log2(np.maximum(chances, 1e-12)).reshape(-1)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (rows) under each language (columns)."""
        codes = _triples(texts)
        size, symbol = np.uint32(self.size), self.symbol
        at = (symbol[codes >> 16] * size + symbol[(codes >> 8) & 255]) * size + symbol[codes & 255]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        found = np.zeros((len(texts), len(self.langs)))
        for k, bits in enumerate(self.bits):
            cost = bits[at]
            for row in range(len(texts)):
                found[row, k] = cost[bounds[row] : bounds[row + 1]].sum(dtype=np.float64)
        return found


def train(rows: DataFrame) -> Model:
    """A model of ``rows`` (lang, text)."""
    known = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counted = map_arrow(known, _count, "lang string, code int, uses bigint").groupBy("lang", "code").agg(F.sum("uses").alias("uses"))
    found = counted.toArrow().to_pandas()
    return Model(
        [(lang, part["code"].to_numpy(), part["uses"].to_numpy()) for lang, part in found.groupby("lang", sort=True)]
    )


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (any columns and text; the text goes) with lang_pred and score, the chance of the language.

    Columns of these two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [name for name in docs.columns if name not in ("text", *NAMES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [text if text and model.langs and _has_letter(text) else b"" for text in utf8(batch.column(batch.schema.get_field_index("text")))]
            lengths = model.lengths(texts) if model.langs else np.zeros((len(texts), 1))
            best = lengths.argmin(axis=1)
            chance = 1 / np.exp2(np.minimum(0, lengths.min(axis=1, keepdims=True) - lengths)).sum(axis=1)
            found = [model.langs[k] if text else UNKNOWN for k, text in zip(best, texts)]
            scores = [float(p) if text else 0.0 for p, text in zip(chance, texts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in others), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*others, *NAMES],
            )

    schema = docs.select(others).schema.add("lang_pred", "string").add("score", "double")
    return map_arrow(docs, run, schema)
