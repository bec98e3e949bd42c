"""Near duplicates by SimHash, linked through covering locality-sensitive hashing.

A fingerprint has a bit for each bit of a 64-bit hash: it is 1 if more than half of the hashes of all
shingles, repeats included, have it. Fingerprints that differ in at most ``radius`` bits link.

Covering hashing gives bit ``i`` a non-zero vector of ``radius + 1`` bits and has one table for each
non-zero vector ``v`` of that length; the table's key is the fingerprint under the mask of the bits
whose vector has an odd product with ``v``. For any ``radius`` bits there is a ``v`` whose product with
all of their vectors is even, so two fingerprints that differ in these bits only have equal keys in the
table of ``v``: every pair within the radius meets in some table, with certainty.

Equal fingerprints are one row before any table is made. Fingerprints that meet in a table are
compared, and how depends on how many meet, not what is found:

- up to ``TOGETHER`` of them: all pairs of that bounded list, by the number of differing bits;
- more: with a radius of two, fingerprints of one key link exactly if some bit string is at most one bit from both,
  where only bits outside of the mask can differ. So each sends its own string and those one bit off
  to that string, where at most 65 fingerprints can meet, all of them within two bits of each other,
  and the smallest one stands for all links.

So no step makes pairs of a whole group, and what it makes per fingerprint is bounded by a constant.

Rows: one output row per document row. Null and empty texts and those of white space have the
fingerprint zero and link with others. Equal rows come back as often as they come. A row without doc_id
gets the smallest doc_id of its component, null if there is none, and never names a component. Extra
columns are ignored. Texts are read in pieces, so a very long one needs no list of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import map_arrow, pieces, utf8
from scorewright.llm.components import components
from scorewright.scale import lookup_join, materialize

WORDS, SEED, RADIUS = 3, 42, 2
BITS = 64
TOGETHER = 16
#: Hashes whose bits are counted at a time.
COUNTED = 1 << 15


def masks(radius: int = RADIUS) -> list[int]:
    """The masks of the tables; for any ``radius`` bits one of them has none of these."""
    vectors = 1 << (radius + 1)
    held = [i % (vectors - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (held[i] & v).bit_count() % 2) for v in range(1, vectors)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _hashes(text: bytes, size: int, seed: int) -> Iterator[list[int]]:
    """Hashes of the shingles of a text, some at a time."""
    kept: list[bytes] = []
    cut = False
    for piece in pieces(text):
        found = kept + piece.lower().split()
        if len(found) >= size:
            line = b" ".join(found)
            ends = list(accumulate((len(word) + 1 for word in found)))
            starts = [0, *ends]
            yield [xxhash.xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :])]
            cut = True
        kept = found[-(size - 1) :] if size > 1 else []
    if kept and not cut:
        yield [xxhash.xxh64_intdigest(b" ".join(kept), seed)]


def fingerprint(text: bytes | None, size: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number; zero without words."""
    total, ones = 0, np.zeros(BITS, np.int64)
    for found in _hashes(text or b"", size, seed):
        total += len(found)
        for start in range(0, len(found), COUNTED):
            part = np.array(found[start : start + COUNTED], "<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, *, size: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row, ``fp`` as a signed number."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(text, size, seed)) for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), part, f"doc_id {kind}, fp bigint")


def links(distinct: DataFrame, *, together: int = TOGETHER) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints within two bits of each other; ``distinct`` has fp."""
    tables = masks(RADIUS)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(mask))) for mask in tables])
    placed = distinct.select("fp", F.posexplode(keys).alias("t", "key"))
    met = placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(lookup_join(placed, met, ["t", "key"], spread=["fp"], how="inner"), "members")

    few = members.where(F.col("n") <= together).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))

    def near(x: Column) -> Column:
        close = F.filter("fps", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= RADIUS))
        return F.transform(close, lambda y: F.struct(x.alias("a"), y.alias("b")))

    pairs = few.select(F.inline(F.flatten(F.transform("fps", near))))

    free = [[0] + [1 << i for i in range(BITS) if not mask >> i & 1] for mask in tables]
    flips = F.array(*[F.array(*[F.lit(_signed(bit)) for bit in bits]) for bits in free])
    many = members.where(F.col("n") > together)
    own = F.transform(F.get(flips, F.col("t")), lambda bit: F.col("fp").bitwiseXOR(bit))
    strings = many.select("fp", F.explode(own).alias("z")).groupBy("z").agg(F.collect_set("fp").alias("fps"))
    stars = strings.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionAll(stars).distinct()


def group_near(docs: DataFrame, *, size: int = WORDS, seed: int = SEED) -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    marked = materialize(fingerprints(docs, size=size, seed=seed), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(links(distinct))
    named = distinct.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("group")
    )
    named = materialize(named, "named")
    roots = named.groupBy("group").agg(F.min("least").alias("component_id"))
    rooted = lookup_join(named.select("fp", "group"), roots, ["group"], spread=["fp"], how="inner")
    found = lookup_join(marked, rooted.select("fp", "component_id"), ["fp"], spread=["doc_id"], how="inner")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
