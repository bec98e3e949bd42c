"""Benchmark passages in documents, found by a prefix-filtered set join of word shingles.

An item is cut into windows of ``window`` consecutive words; an item of fewer words, but not none, is
one window. A window is the set of its shingles (four words, two or one in windows shorter than that)
with their places. It must be contained in the document as a whole, so of its shingles in the order
of their rarity a prefix of one is enough: its rarest shingle has to occur. The steps, all in
DataFrame operations:

1. look up every shingle of every document among the benchmark's and keep the hits, each with the
   words around it (the one pass over the texts),
2. count the hits of each shingle over all documents and give each distinct window its rarest one as
   prefix token,
3. join the hits with the prefix tokens; the place of the shingle fixes the window's place (positional
   bound: not before the first word; length bound: not beyond the last),
4. compare the words there with the window's words,
5. per document, merge the places hit and the items found.

The benchmark is the stated query set. It is joined in blocks of about ``block_rows`` windows, so what
is broadcast has a bound whatever the benchmark's size; a block is one pass over the documents.
Windows that several items share are joined once and carry the list of their items.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case.

Rows: one output row per document row. Null and empty texts have no words and no hits, a null doc_id
is kept, documents that repeat doc_id and text give equal rows. Items with null or empty text match
nothing; items of the same item_id count as one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import lower_ascii, words
from scorewright.scale import materialize

WINDOW = 10
BLOCK_ROWS = 100_000

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingle sizes, each twice the next one; a window takes the first that fits.
SIZES = (4, 2, 1)
#: Stands before the shingles of each document, so that documents without hits keep a row.
MARK = 0


def normal_words(text: Column) -> Column:
    return words(lower_ascii(text), SEPARATORS)


def _shingles(w: Column, size: int) -> Column:
    """Hashes of the ``size``-word shingles, as many as words: the last size - 1 are cut short."""
    if size == 1:
        return F.transform(w, lambda word: F.xxhash64(word))
    half = _shingles(w, size // 2)
    shifted = F.slice(half, size // 2 + 1, F.size(w) + 1)
    return F.zip_with(half, shifted, lambda a, b: F.xxhash64(a, b))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows: window_id, w (words), k (words in its shingles), items (sorted, as strings)."""
    held = items.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("all"))
    held = held.where((F.size("all") > 0) & F.col("item").isNotNull())
    n = F.least(F.size("all"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("all") - n + 1)
    cut = held.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, n))).alias("w"))
    joined = cut.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))
    k = F.lit(None).cast("int")
    for size in reversed(SIZES):
        k = F.when(F.size("w") >= size, F.lit(size)).otherwise(k)
    return joined.select(F.xxhash64("w").alias("window_id"), "w", k.alias("k"), "items")


def _own_shingles(windows: DataFrame) -> DataFrame:
    """All shingles of the windows: window_id, k, hash, offset."""
    hashes = F.lit(None).cast("array<bigint>")
    for size in SIZES:
        hashes = F.when(F.col("k") == size, F.slice(_shingles(F.col("w"), size), 1, F.size("w") - size + 1)).otherwise(hashes)
    return windows.select("window_id", "k", F.posexplode(hashes).alias("offset", "hash"))


def _hits(held: DataFrame, own: DataFrame, sizes: list[int], window: int, *, marks: bool) -> DataFrame:
    """Places of benchmark shingles: doc_id, text_hash, n, place, k, hash, first, around.

    ``around`` are the words in which any window of this shingle would lie, ``first`` is the place of
    the first of them. With ``marks``, every document has one more row with place -1.
    """
    all_hashes = F.concat(F.array(F.lit(MARK).cast("bigint")), *[_shingles(F.col("w"), size) for size in sizes])
    placed = held.select("doc_id", "text_hash", "w", F.size("w").alias("n"), all_hashes.alias("hashes")).select(
        "doc_id", "text_hash", "w", "n", F.posexplode_outer("hashes").alias("at", "hash")
    )
    known = own.select("hash", "k").distinct()
    if marks:
        known = known.unionAll(held.sparkSession.range(1).select(F.lit(MARK).cast("bigint"), F.lit(0)))
    met = placed.join(F.broadcast(known), "hash")
    place = F.when(F.col("at") == 0, F.lit(-1))
    for j, size in enumerate(sizes):
        place = place.when(F.col("k") == size, F.col("at") - 1 - j * F.col("n"))
    met = met.withColumn("place", place).where("place < n AND (place >= 0 OR at = 0)")
    first = F.greatest(F.col("place") - (window - 1), F.lit(0))
    around = F.when(F.col("at") > 0, F.slice("w", first + 1, F.lit(2 * window - 1)))
    return met.select("doc_id", "text_hash", "n", "place", "k", "hash", first.alias("first"), around.alias("around"))


def find_items(
    docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids (sorted strings), text_hash.

    A word is hit that lies in any occurrence of a window of any item.
    """
    windows = materialize(_windows(items, window), "windows")
    blocks = -(-max(1, windows.count()) // block_rows)
    sizes = sorted((row["k"] for row in windows.select("k").distinct().collect()), reverse=True)
    held = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), normal_words(F.col("text")).alias("w"))

    parts = [windows.where(F.pmod("window_id", F.lit(blocks)) == block) for block in range(blocks)]
    hits = [
        materialize(_hits(held, _own_shingles(part), sizes, window, marks=block == 0), "hits")
        for block, part in enumerate(parts)
    ]
    found = hits[0].where("place < 0").select(
        "doc_id", "text_hash", "n", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    for part, met in zip(parts, hits):
        found = found.unionAll(_occurrences(part, met.where("place >= 0")))

    # Marks of equal documents meet in one row and are dealt out again below.
    per = found.groupBy("doc_id", "text_hash").agg(
        F.max("n").alias("n_words"),
        F.count(F.when(F.col("start").isNull(), 1)).alias("_copies"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "stop")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto")),
        lambda done, span: F.struct(
            (done["hit"] + F.greatest(span["stop"] - F.greatest(span["start"], done["upto"]), F.lit(0))).alias("hit"),
            F.greatest(done["upto"], span["stop"]).alias("upto"),
        ),
        lambda done: done["hit"],
    )
    counted = per.select(
        "doc_id",
        F.col("n_words").cast("bigint"),
        hit.cast("bigint").alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        "item_ids",
        "text_hash",
        "_copies",
    )
    return counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copies", "_copy")


def _occurrences(windows: DataFrame, hits: DataFrame) -> DataFrame:
    """Where windows occur: doc_id, text_hash, n, start, stop, items."""
    uses = hits.groupBy("k", "hash").agg(F.count(F.lit(1)).alias("uses"))
    # A window has to have all of its shingles; one whose rarest shingle occurs nowhere is dropped.
    ranked = _own_shingles(windows).join(uses, ["k", "hash"], "left")
    rarest = ranked.groupBy("window_id").agg(
        F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "hash", "offset")).alias("s")
    )
    prefix = rarest.where("s.uses > 0").select("window_id", "s.hash", "s.offset")
    tokens = windows.join(prefix, "window_id").select("k", "hash", "offset", "w", "items")
    met = hits.join(F.broadcast(tokens), ["k", "hash"])
    start, length = F.col("place") - F.col("offset"), F.size("w")
    bounded = met.withColumn("start", start).withColumn("stop", start + length).where("start >= 0 AND stop <= n")
    same = F.slice("around", F.col("start") - F.col("first") + 1, F.size("w")) == F.col("w")
    return bounded.where(same).select("doc_id", "text_hash", "n", "start", "stop", "items")
