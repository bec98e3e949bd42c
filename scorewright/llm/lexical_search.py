"""Ranked lexical search: the best documents of each query, by exact inner products in ball trees.

A document is a sparse vector with one integer per query term it holds, its saturated frequency. A query is the
vector of its terms' weights, so a score is their inner product. (With the weights in the documents' vectors instead,
rare terms would make all radii large, and next to nothing would be skipped.) Steps:

1. One pass over the texts counts terms: of each document all its words, and the frequencies of those
   that are query terms. The result is a table in the shared folder.
2. From that table: documents, words, and documents per query term.
3. Tasks cut their documents into blocks and build a ball tree for each: a node has the centroid of its
   documents and the greatest distance of one to it. No document below a node scores more than
   centroid x query + radius x |query|, where the query counts only at terms that occur below the node,
   since elsewhere all its documents and the centroid are zero. The bound is rounded up by more than its
   floating-point error. Per query, nodes are opened best first until their bound is below the score of the
   k-th document found by the task; equal scores are still opened. Leaves add up 64-bit integers.
4. The best ``k`` of each task meet in one ranking per query.

Before step 3, the k-th best score within a share of the documents is found in the same way. No
document below it can be among the best ``k`` of all, so it is where every task starts from and it keeps
what step 4 moves small. It changes no result, also where that share holds fewer than ``k``.

The queries are the stated query set. They are searched in blocks of about ``block_terms`` terms, so the
vocabulary that is broadcast has a bound; a block is one pass over the documents, and the terms of one
query stay together.

Rows: each query row has up to ``k`` rows of its own, also if it repeats another's item_id. Null and
empty queries, and those without terms, have none. Documents without terms count nowhere. Equal scores
rank by doc_id, null last; repeated documents are ranked each. Extra columns are ignored. Texts are read
in pieces.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import lower_ascii, map_arrow, pieces, utf8, words
from scorewright.scale import materialize

TOP = 50
BLOCK_TERMS = 100_000
#: Numbers in the matrix of one tree.
CELLS = 4_000_000
LEAF = 16
#: One of so many documents is searched first, for a score to start from.
SHARE = 32
SLACK = 1e-9

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEPARATOR = re.compile(SEPARATORS[:-1].encode())
#: A-Z in lower case, separators as blanks.
_FOLD = bytes(ord(" ") if _SEPARATOR.match(bytes([b])) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def term_counts(text: bytes | None) -> Counter[bytes]:
    """Frequencies of the terms of a UTF-8 text."""
    found: Counter[bytes] = Counter()
    for piece in pieces(text or b"", _SEPARATOR):
        found.update(piece.translate(_FOLD).split())
    return found


def _vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (its terms with repeats), terms (numbers of query terms), counts (their frequencies)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            sizes, offsets, terms, counts = [], [0], [], []
            for text in utf8(batch.column(1)):
                found = term_counts(text)
                sizes.append(found.total())
                for term in found.keys() & known.keys():
                    terms.append(known[term])
                    counts.append(found[term])
                offsets.append(len(terms))
            held = pa.array(offsets, pa.int32())
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(held, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(held, pa.array(counts, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n bigint, terms array<int>, counts array<int>"
    return map_arrow(docs.select("doc_id", "text"), part, schema)


class BallTree:
    """A ball tree over the rows of a matrix of non-negative integers; its nodes hold runs of reordered rows."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(rows))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centroids, radii = [], []
        dense = rows.astype(np.float64)
        waiting = [(0, len(rows), None, 0)]
        while waiting:
            start, stop, parent, side = waiting.pop()
            node = len(self.spans)
            self.spans.append((start, stop))
            self.children.append(None)
            if parent is not None:
                left, right = self.children[parent] or (0, 0)
                self.children[parent] = (node, right) if side == 0 else (left, node)
            held = dense[self.order[start:stop]]
            centroid = held.mean(axis=0)
            apart = held - centroid
            far = np.einsum("ij,ij->i", apart, apart)
            centroids.append(centroid)
            # Rounding of the differences is relative to the numbers themselves.
            radii.append(math.sqrt(far.max()) * (1 + SLACK) + SLACK * (float(np.sqrt((centroid**2).sum())) + 1))
            if stop - start <= leaf or not far.any():
                continue
            # Apart by the line between the farthest row and the one farthest from it.
            one = held[far.argmax()]
            from_one = ((held - one) ** 2).sum(axis=1)
            other = held[from_one.argmax()]
            along = held @ (other - one)
            middle = (stop - start) // 2
            self.order[start:stop] = self.order[start:stop][np.argpartition(along, middle)]
            waiting.append((start + middle, stop, node, 1))
            waiting.append((start, start + middle, node, 0))
        self.rows = rows[self.order]
        self.centroids, self.radii = np.array(centroids), np.array(radii)
        self.present = np.array([(self.rows[a:b] > 0).any(axis=0) for a, b in self.spans], np.float64)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Per node and query (columns of weights, 0 for other terms) a number no score below the node exceeds."""
        length = np.sqrt(self.present @ queries**2)
        return (self.centroids @ queries + self.radii[:, None] * length) * (1 + SLACK) + 1e-3


class _Best:
    """The best ``k`` documents of one query so far, and the least score that still counts."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.held = k, least, []

    def add(self, scores: np.ndarray, ids: list) -> None:
        for place in np.flatnonzero(scores >= self.least).tolist():
            self.held.append((-int(scores[place]), ids[place] is None, ids[place] or 0))
        if len(self.held) > self.k:
            self.held = heapq.nsmallest(self.k, self.held)
        if len(self.held) == self.k:
            self.least = max(self.least, -max(self.held)[0])


def _search_tree(tree: BallTree, ids: list, queries: list[np.ndarray], weights: np.ndarray, best: list[_Best]) -> int:
    """Search one tree for all queries (column numbers, weighed alike in all); returns how many leaves were scored."""
    asked = np.zeros((tree.rows.shape[1], len(queries)))
    for number, columns in enumerate(queries):
        asked[columns, number] = weights[columns]
    bounds = tree.bounds(asked)
    opened = 0
    for number in np.flatnonzero(bounds[0] >= [found.least for found in best]).tolist():
        columns, found, bound = queries[number], best[number], bounds[:, number]
        if not len(columns):
            continue
        waiting = [(-bound[0], 0)]
        while waiting:
            above, node = heapq.heappop(waiting)
            if -above < found.least:
                break
            children = tree.children[node]
            if children is None:
                start, stop = tree.spans[node]
                opened += 1
                found.add(tree.rows[start:stop, columns] @ weights[columns], ids[start:stop])
                continue
            for child in children:
                upto = min(-above, bound[child])
                if upto >= found.least:
                    heapq.heappush(waiting, (-upto, child))
    return opened


def _blocks(rows: int, offsets: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents whose matrix has at most ``CELLS`` numbers, one document at least."""
    waiting = [(0, rows)] if rows else []
    while waiting:
        start, stop = waiting.pop()
        used = len(np.unique(terms[offsets[start] : offsets[stop]]))
        if stop - start > 1 and (stop - start) * used > CELLS:
            middle = (start + stop) // 2
            waiting += [(middle, stop), (start, middle)]
        elif used:
            yield start, stop


def _best_of_tasks(vectors: DataFrame, facts, k: int) -> DataFrame:
    """(query, doc_id, score): of each task the best ``k`` documents of each query."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, total, weights, queries, least = facts.value
        best = [_Best(k, bound) for bound in least]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            terms = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            counts = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(ids)), np.diff(offsets))
            m = 50 + (50 * sizes * documents) // max(total, 1)
            values = (1_000_000_000 * counts) // (1000 * counts + 20 * m[owner])
            for start, stop in _blocks(len(ids), offsets, terms):
                inside = slice(offsets[start], offsets[stop])
                used, columns = np.unique(terms[inside], return_inverse=True)
                rows = np.zeros((stop - start, len(used)), np.int64)
                rows[owner[inside] - start, columns] = values[inside]
                tree = BallTree(rows)
                place = np.full(len(weights), -1, np.int64)
                place[used] = np.arange(len(used))
                asked = [found[found >= 0] for found in (place[query] for query in queries)]
                _search_tree(tree, [ids[start + i] for i in tree.order.tolist()], asked, weights[used], best)
        found = [(q, None if none else doc, -score) for q, held in enumerate(best) for score, none, doc in held.held]
        columns = list(zip(*found)) or [(), (), ()]
        kinds = [pa.int32(), id_type, pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(column), kind) for column, kind in zip(columns, kinds)], ["query", "doc_id", "score"]
        )

    kind = vectors.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32()}[kind]
    return map_arrow(vectors, part, f"query int, doc_id {kind}, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, asked: list[tuple], k: int) -> DataFrame:
    """Ranks all documents for the queries of one block, (item_id, terms) each."""
    spark = docs.sparkSession
    context = spark.sparkContext
    vocabulary = {term: number for number, term in enumerate(sorted({t for _, terms in asked for t in terms}))}
    known = context.broadcast({term.encode(): number for term, number in vocabulary.items()})
    vectors = materialize(_vectors(docs, known), "vectors")
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # block_terms rows at most
        weights[row["term"]] = math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * row["count"] + 1)))
    queries = [np.array([vocabulary[t] for t in terms], np.int64) for _, terms in asked]

    def best(of: DataFrame, least: list[int]) -> DataFrame:
        return _best_of_tasks(of, context.broadcast((total["n"], total["l"], weights, queries, least)), k)

    some = vectors.where((F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0) & (F.size("terms") > 0))
    least = [1] * len(queries)
    for row in _ranked(best(some, least), k).where(F.col("rank") == k).collect():  # one row a query
        least[row["query"]] = max(1, row["score"])
    ranked = materialize(_ranked(best(vectors.where(F.size("terms") > 0), least), k), "ranked")
    names = spark.createDataFrame([(number, item) for number, (item, _) in enumerate(asked)], "query int, item_id bigint")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, *, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the ``k`` documents of the highest score above zero."""
    found = F.array_sort(F.array_distinct(words(lower_ascii(F.col("text")), SEPARATORS)))
    asked = items.select("item_id", found.alias("terms")).where(F.size("terms") > 0)
    asked = materialize(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = -(-max(1, asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // block_terms)
    result = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).orderBy("query").collect()
        if part:
            one = _search_block(docs, [(row["item_id"], row["terms"]) for row in part], k)
            result = one if result is None else result.unionAll(one)
    if result is not None:
        return result
    return docs.limit(0).select(
        F.lit(0).cast("bigint").alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("bigint").alias("score")
    )
