"""Token ids of a corpus as shuffled, compressed byte or bit planes.

Texts are sorted by document id over range partitions, encoded with a public tokenizer and written as
segments. A segment is one Parquet row that holds whole documents:

* ``part``, ``seq``: write task and number of the segment in it; ``start``: ids of the part before it,
* ``doc_ids``, ``doc_sizes``: the documents in order and how many ids each has,
* ``block``, ``planes``: ids per block and planes per block (4 byte planes or 32 bit planes),
* ``lengths``: the chunk index, one compressed length per block and plane, in order,
* ``chunks``: the zstandard frames of all planes, one after the other.

The ids of a segment form one run that is cut into blocks of ``block`` ids, the last one shorter. A
block is transposed: plane k of a byte block holds byte k of every id, so the planes that are nearly
constant shrink to almost nothing. A reader that wants one document finds it by ``doc_sizes`` and
decodes only the blocks it touches; segments decode apart from each other.

Rows: a null text counts as empty and has the end id only. Null document ids sort first. Rows that
share a document id stay next to each other, in no set order. An empty table gives no segments. A
text longer than ``segment`` ids makes one longer segment. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from string import ascii_letters
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import map_arrow, pieces, utf8
from scorewright.scale import scratch_path

BLOCK_IDS = 65_536
SEGMENT_IDS = 1 << 20
PLANES = {"byte": 4, "bit": 32}
LEVEL = 3
CACHED_WORDS = 1_000_000

SEGMENT = (
    "part int, seq int, start bigint, doc_ids array<bigint>, doc_sizes array<bigint>, block int, planes int, "
    "lengths array<int>, chunks binary"
)
#: Bytes of text that are split into words at once.
TEXT_BYTES = 1 << 22
TAIL = b".,!?;:*$%#&|-_()[]{}<>/\\@+=~^\"`"


def _plain_letters() -> frozenset[bytes]:
    """Two-byte letters that are one letter before and after composition and lower-casing."""
    kept = []
    for letter in map(chr, range(0x80, 0x250)):
        lowered = unicodedata.normalize("NFC", letter).lower()
        if letter.isalpha() and unicodedata.normalize("NFC", letter) == letter and len(lowered) == 1 and lowered.isalpha():
            kept.append(letter.encode())
    return frozenset(kept)


PLAIN = _plain_letters()


class WordIds(dict):
    """Ids of words between ASCII white space, as little-endian 32-bit integers.

    The vocabulary splits at white space, so a text's ids are those of its words in order. It also splits
    between a letter and punctuation; where both are ASCII the word is taken apart there, and both parts are
    kept. Behind other letters it is not: the tokenizer normalises first, and some letters then end in a mark, which
    goes with the punctuation. Only letters of ``PLAIN``, which stay letters, count as ASCII ones do.

    A run of such letters is one piece for the tokenizer, and what it makes of each letter does not hang on
    the others: these words go straight to its model, letter by letter as it writes them. It sees all others
    whole. Holds about ``CACHED_WORDS`` entries, then starts anew.
    """

    def __init__(self, vocabulary: str):
        # Spark runs tasks side by side; threads of the library would only compete with them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._pieces = self._tokenizer.model.tokenize
        letters = [*ascii_letters, *map(bytes.decode, PLAIN)]
        self._written = {ord(letter): self._write(letter) for letter in letters}
        self._plain = re.compile(f"[{''.join(letters)}]+").fullmatch

    def _write(self, letter: str) -> str:
        """A letter in the alphabet of the model."""
        normal = self._tokenizer.normalizer.normalize_str(letter)
        return "".join(piece for piece, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(normal))

    def _encode(self, part: bytes) -> bytes:
        text = part.decode()
        if self._plain(text):
            ids = [piece.id for piece in self._pieces(text.translate(self._written))]
        else:
            ids = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return pack_ids(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(TAIL)
        tail = word[len(core) :]
        if core.isalpha():
            core = core.lower()
            if core == word:
                found = self._encode(word)
            else:
                found = self[core] + self[tail] if tail else self[core]
        elif core and tail and b"<" not in word and (core[-1:].isalpha() or core[-2:] in PLAIN):
            found = self[core] + self[tail]
        else:
            found = self._encode(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found

    def texts(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of each text, in order; a long text is split into words a few megabytes at a time."""
        for text in texts:
            yield b"".join([b"".join(map(self.__getitem__, piece.split())) for piece in pieces(text, size=TEXT_BYTES)])


_word_ids: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    """One cache per worker process and vocabulary, kept from task to task."""
    if vocabulary not in _word_ids:
        _word_ids[vocabulary] = WordIds(vocabulary)
    return _word_ids[vocabulary]


def to_planes(ids: np.ndarray, kind: str) -> np.ndarray:
    """One row per plane of a block of 32-bit ids."""
    as_bytes = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return np.ascontiguousarray(as_bytes.T)
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    """The block that ``to_planes`` took apart."""
    rows = np.stack([np.frombuffer(plane, np.uint8) for plane in planes])
    if len(planes) == PLANES["bit"]:
        bits = np.unpackbits(rows, axis=1, count=n_ids, bitorder="little")
        rows = np.packbits(bits.T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


def pack(ids: bytes, block: int, kind: str) -> tuple[list[int], bytes]:
    """Chunk index and compressed planes of a run of ids."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    run = np.frombuffer(ids, "<u4")
    chunks = [
        press.compress(plane.tobytes())
        for at in range(0, len(run), block)
        for plane in to_planes(run[at : at + block], kind)
    ]
    return [len(chunk) for chunk in chunks], b"".join(chunks)


def unpack(lengths: list[int], chunks: bytes, n_ids: int, block: int, planes: int) -> np.ndarray:
    """The run of ids that ``pack`` took."""
    expand = zstandard.ZstdDecompressor()
    ends = np.cumsum([0, *lengths]).tolist()
    frames = [expand.decompress(chunks[a:b]) for a, b in zip(ends, ends[1:])]
    blocks = [
        from_planes(frames[k * planes : (k + 1) * planes], min(block, n_ids - at))
        for k, at in enumerate(range(0, n_ids, block))
    ]
    return np.concatenate(blocks) if blocks else np.empty(0, "<u4")


def _segments(vocabulary: str, end_id: int, block: int, segment: int, kind: str):
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids_of = TaskContext.get().partitionId(), word_ids(vocabulary)
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        seq = start = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, doc_ids, sizes, seq, start
            lengths, chunks = pack(b"".join(held), block, kind)
            row = [part, seq, start, doc_ids, sizes, block, PLANES[kind], lengths, chunks]
            seq, start = seq + 1, start + sum(sizes)
            held, doc_ids, sizes = [], [], []
            return pa.RecordBatch.from_arrays(
                [pa.array([value], kind_) for value, kind_ in zip(row, _ARROW)], [name for name in _NAMES]
            )

        size = 0
        for batch in batches:
            texts = (text or b"" for text in utf8(batch.column(1)))
            for doc_id, found in zip(batch.column(0).to_pylist(), ids_of.texts(texts)):
                ids = found + end
                held.append(ids)
                doc_ids.append(doc_id)
                sizes.append(len(ids) // 4)
                size += len(ids) // 4
                if size >= segment:
                    yield flush()
                    size = 0
        if doc_ids:
            yield flush()

    return encode


_NAMES = [field.split()[0] for field in SEGMENT.split(", ")]
_ARROW = [
    pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(),
    pa.list_(pa.int32()), pa.binary(),
]


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    *,
    end_id: int,
    block: int = BLOCK_IDS,
    segment: int = SEGMENT_IDS,
    kind: str = "byte",
) -> None:
    """Encode ``docs`` (doc_id, text) in ascending order of doc_id and write its segments to ``path``."""
    ranged = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id")
    encode = _segments(vocabulary, end_id, block, segment, kind)
    rows = map_arrow(ranged.sortWithinPartitions("doc_id"), encode, SEGMENT)
    rows.write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            sizes = row["doc_sizes"]
            ids = unpack(row["lengths"], row["chunks"], sum(sizes), row["block"], row["planes"])
            ends = np.cumsum([0, *sizes])
            texts = [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * len(sizes), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array((ends[:-1] + row["start"]).tolist(), pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(text) for text in texts], pa.int64()),
                    pa.array(texts, pa.binary()),
                ],
                ["part", "doc_id", "in_part", "n_tokens", "ids_crc32", "ids"],
            )


def read(spark, path: str) -> DataFrame:
    """One row per document of a written store: doc_id, start, n_tokens, ids_crc32, ids.

    ``ids`` are the document's ids as little-endian unsigned 32-bit integers. The table of part
    offsets has one row per write task, so it is small enough to broadcast.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    sizes = segments.groupBy("part").agg(F.sum(F.aggregate("doc_sizes", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("n"))
    totals = dict(sizes.collect())
    offsets, before = [], 0
    for part in sorted(totals):
        offsets.append((part, before))
        before += totals[part]
    first = F.broadcast(spark.createDataFrame(offsets, "part int, _before bigint"))
    rows = map_arrow(
        segments, _documents, "part int, doc_id bigint, in_part bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    )
    joined = rows.join(first, "part")
    return joined.select("doc_id", (F.col("_before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", "ids")


def store(docs: DataFrame, vocabulary: str, *, end_id: int, **options) -> DataFrame:
    """Write ``docs`` to a fresh folder of the shared storage and read it back."""
    path = scratch_path(docs.sparkSession, "token-store")
    write(docs, path, vocabulary, end_id=end_id, **options)
    return read(docs.sparkSession, path)
