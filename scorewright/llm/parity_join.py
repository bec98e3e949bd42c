"""Jaccard self-join of shingle sets: candidates by a prefix filter, all kept ones verified.

Two sets of a and b shingles whose intersection is at least t of the union
share at least t / (1 + t) * (a + b) shingles, so at most a quarter (1 - t) of the one set's shingles
differ, and any quarter and one more of them hold a common one, as
long as both sets choose in the same order. Each set hands out the hashes of that many of its rarest shingles,
called words below (rarity
is counted over all documents in a histogram of fixed size; it is the order only, so any counts give
whole results), and sets that share enough of them (``_needed``) are candidates. The words go by size
band, the bands' bounds being powers of eight; a set whose partners may lie in the next band hands
out its words there too.

Candidates are held against each other by bit sketches next: the parities of the shingles in a few
times as many cells as there are shingles. Each shingle that only one set has flips one cell, so the
Hamming distance is at most the symmetric difference, which is at most (1 - t) / (1 + t) * (a + b) for
similar sets. Pairs that are too far apart are dropped without their texts.

Candidates are not all paired. A bucket is the list of documents that share a word. First, and
``STARS`` times (once is enough), each document is held against one that stands for the largest component of its
buckets; the verified links are joined to components. Copies, in groups of any size, are then one
component. What is left are documents outside of the largest component of a bucket. Where that one is a family of
more than ``FAMILY`` members, they are held against all of it at once, by their deviations from what most members
have in common (see ``families``). All other pairs of different components within a bucket are verified one
by one, so no link between components is lost. Verification is on the whole shingle sets.

A word that is in very many documents is spread over several tasks by document; see ``salt_at``.

Rows: one output row per input row. Null and empty texts have an empty set and link with nothing. A
null doc_id links with nothing and has a null component. Rows that share a doc_id are one node, which
has the links of all its rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import map_arrow, utf8
from scorewright.llm.components import components
from scorewright.llm.families import family_links
from scorewright.llm.shingles import mix, shingle_set, similar
from scorewright.scale import fits_broadcast, lookup_join, materialize

SIZE = 5
PERCENT = 75
RARITY_BITS = 24
RANKS_PER_DOUBLING = 6
KEYS_PER_GROUP = 4_000_000
GROUPS_PER_PARTITION = 8
SALT_AT = 4_000_000
STARS = 1
SETS_KEPT = 200
#: Members from which on a component is no longer held against others member by member.
FAMILY = 16

BAND = 8
SLICES = 64


def sketch(hashes: np.ndarray, percent: int) -> tuple[list[np.ndarray], int, int]:
    """The words of a set, as keys for each of its bands, and how many to hand out.

    The last number is how many of those are enough towards partners that are not smaller.
    """
    n = len(hashes)
    if not n:
        return [], 0, 0
    top = BAND
    while top < n:
        top *= BAND
    bands = [top, top * BAND] if 100 * n // percent > top else [top]
    few = (100 - percent) * n // (100 + percent) + 1
    return [mix(hashes + np.uint64(width)) for width in bands], (100 - percent) * n // 100 + 1, few


def _profile(size: int, percent: int, bits: int):
    """Per document its set's size, and per task how often keys fall in each cell of the histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            sizes, keys = [], []
            for text in utf8(batch.column(1)):
                hashes = shingle_set(text, size)
                sizes.append(len(hashes))
                keys += sketch(hashes, percent)[0]
            if keys:
                np.add.at(counts, np.concatenate(keys) >> np.uint64(64 - bits), np.uint32(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())],
                ["doc_id", "n", "slice", "counts"],
            )
        press = zstandard.ZstdCompressor(level=1)
        parts = [press.compress(part.tobytes()) for part in np.split(counts, SLICES)] if counts.any() else []
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
            ["doc_id", "n", "slice", "counts"],
        )

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tasks' counts of each slice, as one-byte ranks: eight times the binary logarithm."""
    sums: dict[int, np.ndarray] = {}
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(expand.decompress(counts), np.uint32)
            sums[part] = sums[part] + own if part in sums else own.astype(np.int64)
    ranks = {part: np.minimum(np.log2(own + 1.0) * RANKS_PER_DOUBLING, 255).astype(np.uint8) for part, own in sums.items()}
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(ranks), pa.int32()), pa.array([own.tobytes() for own in ranks.values()], pa.binary())], ["slice", "ranks"]
    )


def _salts(ranks: np.ndarray, salt_at: int) -> np.ndarray:
    """Tasks over which words of these ranks are spread, at least one."""
    return np.maximum(np.exp2(ranks / RANKS_PER_DOUBLING) / salt_at, 1).astype(np.uint64)


def _hand_out(size: int, percent: int, groups: int, rarity, bits: int, salt_at: int):
    """Each document's rarest words, gathered by group: (grp, keys, docs, rare), three arrays as bytes.

    ``rare`` marks the first of them, which are enough towards partners that are not smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, shift, low = rarity.value, np.uint64(64 - bits), np.uint64((1 << 56) - 1)
        for batch in batches:
            all_keys, all_docs, all_rare = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                found, wanted, few = sketch(shingle_set(text, size), percent)
                for keys in found:
                    order = (rank[keys >> shift].astype(np.uint64) << np.uint64(56)) | (keys & low)
                    chosen = np.argsort(order)[:wanted]
                    keys = keys[chosen]
                    all_keys.append(keys)
                    all_rare.append(np.arange(len(keys)) < few)
                    all_docs.append(np.full(len(keys), doc_id, np.int64))
            if not all_keys:
                continue
            keys, docs, rare = np.concatenate(all_keys), np.concatenate(all_docs), np.concatenate(all_rare)
            salt = mix(docs.astype(np.uint64)) % _salts(rank[keys >> shift], salt_at)
            grp = mix(keys + salt) % np.uint64(groups)
            order = np.argsort(grp, kind="stable")
            grp, keys, docs, rare = grp[order], keys[order], docs[order], rare[order]
            starts = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1]))).tolist()
            ends = [*starts[1:], len(grp)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grp[starts].astype(np.int64)),
                    pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([docs[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([rare[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ],
                ["grp", "keys", "docs", "rare"],
            )

    return run


def _bucket_rows(keys: np.ndarray, docs: np.ndarray, rare: np.ndarray, hot: np.ndarray) -> pa.RecordBatch | None:
    """Documents of the keys held by more than one; keys with the same documents make one bucket.

    ``words`` says how many keys a bucket stands for, ``rare`` whether a document has one marked so.
    """
    order = np.lexsort((~rare, docs, keys))
    keys, docs, rare, hot = keys[order], docs[order], rare[order], hot[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])))
    keys, docs, rare, hot = keys[new], docs[new], rare[new], hot[new]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.append(starts, len(keys)))
    names = mix(np.add.reduceat(mix(docs.astype(np.uint64)), starts) + lengths.astype(np.uint64))
    spread = hot[starts]
    names[spread] = keys[starts][spread]
    kept = np.flatnonzero((lengths > 1) | spread)
    if not len(kept):
        return None
    same, once, which, often = np.unique(names[kept], return_index=True, return_inverse=True, return_counts=True)
    # A key's documents are in order, so like buckets have theirs at the same places.
    rows = np.repeat(starts[kept] - np.cumsum(lengths[kept]) + lengths[kept], lengths[kept]) + np.arange(lengths[kept].sum())
    sizes = lengths[kept[once]]
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(rows)) - np.repeat(np.cumsum(lengths[kept]) - lengths[kept], lengths[kept])
    marked = np.zeros(sizes.sum(), bool)
    np.logical_or.at(marked, np.repeat(begins[which], lengths[kept]) + place, rare[rows])
    firsts = np.repeat(starts[kept[once]] - begins, sizes) + np.arange(sizes.sum())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(same, sizes).view(np.int64)),
            pa.array(docs[firsts]),
            pa.array(np.repeat(often, sizes).astype(np.int64)),
            pa.array(marked),
        ],
        ["bucket", "doc_id", "words", "rare"],
    )


def _buckets(rarity, bits: int, salt_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, shift = rarity.value, np.uint64(64 - bits)
        group, held = None, ([], [], [])

        def done() -> Iterator[pa.RecordBatch]:
            if held[0]:
                keys, docs, rare = (np.frombuffer(b"".join(parts), kind) for parts, kind in zip(held, (np.uint64, np.int64, bool)))
                rows = _bucket_rows(keys, docs, rare, _salts(rank[keys >> shift], salt_at) > 1)
                if rows is not None:
                    yield rows

        for batch in batches:
            for grp, *parts in zip(*(column.to_pylist() for column in batch.columns)):
                if grp != group:
                    yield from done()
                    group, held = grp, ([], [], [])
                for whole, part in zip(held, parts):
                    whole.append(part)
        yield from done()

    return run


def bit_sketch(hashes: np.ndarray) -> bytes:
    """Parity of the shingles in each of 4 to 8 times as many cells as there are shingles."""
    cells = max(8, 4 << (len(hashes) - 1).bit_length())
    place = ((hashes >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Cells in which two bit sketches differ; the longer one is folded to the width of the other.

    Each shingle that only one set has flips one cell, so this is at most the symmetric difference.
    """
    one, two = (np.unpackbits(np.frombuffer(bits, np.uint8)) for bits in (a, b))
    if len(one) > len(two):
        one = np.bitwise_xor.reduce(one.reshape(len(two), -1), axis=1)
    elif len(two) > len(one):
        two = np.bitwise_xor.reduce(two.reshape(len(one), -1), axis=1)
    return int(np.count_nonzero(one != two))


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, size) for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(hashes) for hashes in sets], pa.int64()),
                    pa.array([bit_sketch(hashes) for hashes in sets], pa.binary()),
                ],
                ["doc_id", "n", "bits"],
            )

    return run


def _close(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, bits_a, bits_b = (column.to_pylist() for column in batch.columns)
            kept = [
                hamming(x, y) <= (100 - percent) * (n + m) // (100 + percent)
                for n, m, x, y in zip(n_a, n_b, bits_a, bits_b)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_of = lru_cache(SETS_KEPT)(partial(shingle_set, size=size))
        for batch in batches:
            both = zip(utf8(batch.column(2)), utf8(batch.column(3)))
            kept = [a == b or similar(set_of(a), set_of(b), percent) for a, b in both]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _on_both(pairs: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
    """``pairs`` (a, b) with columns of ``table`` (doc_id, ...) for either side."""
    sides = [
        table.withColumnsRenamed({"doc_id": side} | {name: f"{name}_{side}" for name in names}) for side in ("a", "b")
    ]
    joined = pairs.join(sides[1], "b").join(sides[0], "a")
    return joined.select("a", "b", *[f"{name}_{side}" for name in names for side in ("a", "b")])


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of the document ids, written to the shared folder."""
    needed = materialize(ids.distinct(), "needed")
    wanted = F.broadcast(needed) if fits_broadcast(needed) else needed
    return materialize(docs.join(wanted, "doc_id", "left_semi"), "texts")


def verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of document ids whose shingle sets are similar; written to the shared folder.

    Pairs whose bit sketches differ in too many cells are dropped before any text is joined to them.
    """
    pairs = materialize(pairs, "pairs")
    texts = _texts_of(docs, pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")))
    sketches = materialize(map_arrow(texts, _sketches(size), "doc_id bigint, n bigint, bits binary"), "sketches")
    close = map_arrow(_on_both(pairs, sketches, ["n", "bits"]), _close(percent), "a bigint, b bigint")
    close = materialize(close.distinct(), "close")
    same = map_arrow(_on_both(close, texts, ["text"]), _verify(size, percent), "a bigint, b bigint")
    return materialize(same.distinct(), "verified")


def _needed(x: str, y: str, percent: int) -> Column:
    """Words that two similar sets share at least among those handed out, by their sizes.

    Of the set whose last word comes first in the order, all but those that differ are in both
    selections. Where a document id has texts of several sizes, one word is enough.
    """
    both = F.ceil(percent * (F.col(f"{x}.most") + F.col(f"{y}.most")) / (100 + percent))
    least = F.least(*[
        F.floor((100 - percent) * F.col(f"{side}.most") / 100) + 1 - F.col(f"{side}.most") + both for side in (x, y)
    ])
    plain = (F.col(f"{x}.least") == F.col(f"{x}.most")) & (F.col(f"{y}.least") == F.col(f"{y}.most"))
    return F.when(plain, F.greatest(least, F.lit(1))).otherwise(F.lit(1))


def _can_link(x: str, y: str, percent: int) -> Column:
    """Do the sizes allow a link?"""
    return (F.col(f"{x}.most") * 100 >= F.col(f"{y}.least") * percent) & (
        F.col(f"{y}.most") * 100 >= F.col(f"{x}.least") * percent
    )


def _open_buckets(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Buckets with more than one component: bucket, words, rare, own, label, largest (of its components)."""
    own = F.struct("doc_id", "least", "most").alias("own")
    if labels is None:
        return buckets.select("bucket", "words", "rare", own, F.col("doc_id").alias("label"), F.lit(None).cast("bigint").alias("largest"))
    known = buckets.join(labels, buckets["doc_id"] == labels["node"], "left").select(
        "bucket", "words", "rare", own, F.coalesce("label", "doc_id").alias("label")
    )
    parts = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("bucket").agg(
        F.max(F.struct("n", "label"))["label"].alias("largest"), F.count(F.lit(1)).alias("parts")
    )
    return materialize(known.join(largest.where("parts > 1").select("bucket", "largest"), "bucket"), "open")


def _star_pairs(mixed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each document with one from the largest component of its buckets, that of most shared words.

    One member stands for the component in a bucket, another one at every turn.
    """
    order = F.struct(F.xxhash64("own.doc_id", F.lit(turn)) if turn else F.col("own.doc_id"), "own")
    inside = mixed.where("largest IS NULL OR label = largest")
    hubs = inside.groupBy("bucket").agg(F.min(order)["own"].alias("hub"))
    met = mixed.join(hubs, "bucket").where("own.doc_id <> hub.doc_id AND (largest IS NULL OR label <> largest)")
    shared = met.where(_can_link("own", "hub", percent)).groupBy("own", "hub").agg(F.sum("words").alias("n"))
    able = shared.where(F.col("n") >= _needed("own", "hub", percent))
    best = able.groupBy(F.col("own.doc_id").alias("b")).agg(F.max(F.struct("n", (-F.col("hub.doc_id")).alias("minus"))).alias("best"))
    return best.select((-F.col("best.minus")).alias("a"), "b")


def _open_pairs(mixed: DataFrame, labels: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that share a word which the smaller set has marked as rare.

    Of two similar sets, at most a seventh (1 - t) / (1 + t) of the smaller one's words differ, so fewer
    of its words are enough. In a bucket, the members outside its largest component are held against
    all others; not against those inside where that was one of the ``families``, since what links they have
    to these is settled. ``labels`` are the components by now.
    """
    now = labels.select(F.col("node"), F.col("label").alias("by_now"))
    settled = families.select(F.col("family").alias("largest"), F.lit(True).alias("settled"))
    marked = mixed.join(settled, "largest", "left").join(now, F.col("own.doc_id") == F.col("node"), "left")
    marked = marked.withColumn("now", F.coalesce("by_now", "own.doc_id"))
    few = marked.where("label <> largest").select("bucket", F.col("own").alias("x"), F.col("now").alias("lx"), F.col("rare").alias("rx"))
    many = marked.where("label <> largest OR settled IS NULL").select(
        "bucket", F.col("own").alias("y"), F.col("now").alias("ly"), F.col("rare").alias("ry"), (F.col("label") == F.col("largest")).alias("inside")
    )
    once = F.col("inside") | (F.col("x.doc_id") < F.col("y.doc_id"))
    smaller = F.struct("x.most", "x.doc_id") < F.struct("y.most", "y.doc_id")
    plain = (F.col("x.least") == F.col("x.most")) & (F.col("y.least") == F.col("y.most"))
    rare = F.when(plain, F.when(smaller, F.col("rx")).otherwise(F.col("ry"))).otherwise(F.lit(True))
    met = few.join(many, "bucket").where((F.col("lx") != F.col("ly")) & once & rare & _can_link("x", "y", percent))
    return met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _families(mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components to settle as a whole (family), and (family, doc_id, inside) of all documents that meet them."""
    met = mixed.select(F.col("largest").alias("family"), F.col("own.doc_id").alias("doc_id"), (F.col("label") == F.col("largest")).alias("inside"))
    members = materialize(met.distinct(), "met")
    sizes = members.groupBy("family").agg(F.count_if("inside").alias("n")).where(F.col("n") > FAMILY).select("family")
    families = materialize(sizes, "families")
    return families, lookup_join(members, families, ["family"], spread=["doc_id"], how="left_semi", stored=True)


def join_near(
    docs: DataFrame,
    *,
    size: int = SIZE,
    percent: int = PERCENT,
    rarity_bits: int = RARITY_BITS,
    salt_at: int = SALT_AT,
    group_keys: int = KEYS_PER_GROUP,
) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, component_id), and the verified links (a, b) that join them.

    The links are enough to give the components of all links, but they are not all of them. ``rarity_bits``: the histogram has that power of two of one-byte cells;
    more of them tell more words apart in a larger corpus. ``salt_at``: uses of a sketch word from which on it is spread.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    profile = map_arrow(texts, _profile(size, percent, rarity_bits), "doc_id bigint, n bigint, slice int, counts binary")
    profile = materialize(profile, "profile")
    parts = profile.where("slice IS NOT NULL").select("slice", "counts").repartition("slice")
    rank = np.zeros(1 << rarity_bits, np.uint8)
    width = len(rank) // SLICES
    for row in map_arrow(parts, _add_up, "slice int, ranks binary").collect():  # one byte for each cell
        rank[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["ranks"], np.uint8)
    rarity = spark.sparkContext.broadcast(rank)
    rows = profile.where("slice IS NULL").select("doc_id", "n")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(partitions * GROUPS_PER_PARTITION, total // group_keys + 1)
    named = texts.where("doc_id IS NOT NULL")
    handed = map_arrow(named, _hand_out(size, percent, groups, rarity, rarity_bits, salt_at), "grp bigint, keys binary, docs binary, rare binary")
    grouped = handed.repartition("grp").sortWithinPartitions("grp")
    parts = map_arrow(grouped, _buckets(rarity, rarity_bits, salt_at), "bucket bigint, doc_id bigint, words bigint, rare boolean")
    sizes = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("n").alias("least"), F.max("n").alias("most")
    )
    met = parts.groupBy("bucket", "doc_id").agg(
        F.sum("words").alias("words"), F.max("rare").alias("rare")
    )
    buckets = materialize(met.join(sizes, "doc_id"), "buckets")

    links = labels = None
    for turn in range(STARS):
        found = verified(named, _star_pairs(_open_buckets(buckets, labels), turn, percent), size, percent)
        links = found if links is None else links.unionAll(found)
        labels = components(links)
    mixed = _open_buckets(buckets, labels)
    families, members = _families(mixed)
    of_families = _texts_of(named, members.select("doc_id"))
    links = links.unionAll(materialize(family_links(members, of_families, size=size, percent=percent), "settled"))
    by_now = materialize(components(links), "labels")
    links = links.unionAll(verified(named, _open_pairs(mixed, by_now, families, percent), size, percent))
    labels = components(links)
    return (
        rows.join(labels, rows["doc_id"] == labels["node"], "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id")
        ),
        links,
    )


def first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text and any columns) with one row of each group of near duplicates: that of the smallest doc_id.

    Rows that share a doc_id and a text are one document; those of unlike texts are one each, named by a hash
    of both. Documents without words, and those without doc_id, are in no group and stay. Columns named like
    those made on the way go.
    """
    docs = docs.drop("_hash", "_node", "_unlike", "_row", "component_id", "least")
    columns = docs.columns
    named = docs.where("doc_id IS NOT NULL").select("*", F.xxhash64("text").alias("_hash"))
    sizes = named.groupBy("doc_id").agg((F.min("_hash") != F.max("_hash")).alias("_unlike"))
    known = lookup_join(named, sizes.where("_unlike"), ["doc_id"], spread=["_hash"])
    own = F.xxhash64("doc_id", "text")
    keyed = known.withColumn("_node", F.when(F.col("_unlike"), own).otherwise(F.col("doc_id").cast("bigint")))
    found = join_near(keyed.select(F.col("_node").alias("doc_id"), "text"), **options)[0]
    groups = found.select(F.col("doc_id").alias("_node"), "component_id").distinct()
    members = keyed.select("_node", "doc_id", "_hash").distinct().join(groups, "_node")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "_hash", "_node")).alias("least"))
    once = Window.partitionBy("_node").orderBy("_hash")
    kept = keyed.join(first.select("least._node"), "_node").withColumn("_row", F.row_number().over(once)).where("_row = 1")
    return kept.select(columns).unionByName(docs.where("doc_id IS NULL"))
