"""Links between a large component of near copies and the sets outside of it, without pairing them all.

Symmetric differences add up as bits do: for any third set B, x and y differ in exactly the elements in which
one of ``x ^ B`` and ``y ^ B`` holds an element and the other does not. So with e = |x ^ B| and n = |x|, x and y
are similar (intersection at least ``percent`` of the union) exactly if

    (100 + p) * (e_x + e_y - 2 * |shared deviations|) <= (100 - p) * (n_x + n_y),

which, with the slack s = (100 + p) * e - (100 - p) * n of a set, is ``2 * (100 + p) * shared >= s_x + s_y``.

B is made for each component, so that its members deviate little: the shingles that most of ``SHOWN`` members
hold. Any B gives the same links, a good one gives them with little work:

1. A set outside whose slack and the least slack inside add up to zero or less is linked to that member for
   certain, whatever they share.
2. Any other needs a number of shared deviations that is known from its own slack and the least inside, and so does
   a member from its slack and the least outside. Only deviations that occur on both sides can be shared; a set with
   fewer of them than it needs has no link. Else the rarest shared one is among all but as many as it needs and one of
   either, in order of rarity (prefix filter on both sides), and pairs that meet there are counted out exactly.

Members of near copies deviate in few shingles and hardly ever in the same ones, so a set outside meets few of
them, where plain verification would have to hold it against every single one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import map_arrow, utf8
from scorewright.llm.shingles import shingle_set
from scorewright.scale import lookup_join, materialize

SHOWN = 25


def _sets(size: int):
    """(family, shingles) of the members shown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, size).view(np.int64) for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["family", "shingles"])

    return run


def _deviations(size: int, percent: int):
    """(family, doc_id, inside, slack, deviations) of rows with their text and the centre of the family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slack, apart = [], []
            centres = batch.column(4)
            for row, text in enumerate(utf8(batch.column(3))):
                own = shingle_set(text, size)
                centre = np.sort(np.asarray(centres[row].values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64))
                found = np.setxor1d(own, centre, assume_unique=True)
                slack.append((100 + percent) * len(found) - (100 - percent) * len(own))
                apart.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(slack, pa.int64()), pa.array(apart, pa.list_(pa.int64()))],
                ["family", "doc_id", "inside", "slack", "deviations"],
            )

    return run


def _enough(rows: DataFrame, label: str) -> DataFrame:
    """Rows (one per set and shingle) of sets that have as many as they need, stored."""
    rows = materialize(rows, label)
    held = rows.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.max("needs").alias("least")).where("n >= least")
    return rows.join(held.select("row", "n"), "row")


def _prefix(rows: DataFrame, uses: DataFrame, label: str) -> DataFrame:
    """Of each set its rarest shingles in ``uses``, all but as many as it needs and one."""
    met = lookup_join(rows.drop("n"), uses, ["family", "shingle"], spread=["row"], how="inner", stored=True)
    by_rarity = Window.partitionBy("row").orderBy("uses", "shingle")
    nth, n = F.row_number().over(by_rarity), F.count(F.lit(1)).over(Window.partitionBy("row"))
    ranked = met.withColumns({"nth": nth, "all": n}).where("nth <= all - needs + 1")
    return materialize(ranked.drop("nth", "all", "uses"), label)


def family_links(members: DataFrame, texts: DataFrame, *, size: int, percent: int) -> DataFrame:
    """Links (a, b) between members and others: for each one outside, all it has to members, or a certain one alone.

    ``members`` has ``family``, ``doc_id`` and ``inside``, once per family and document; ``texts`` the texts of
    all these documents, several rows for one doc_id if it has several texts. Sets without shingles link
    with nothing.
    """
    members = materialize(members, "family")
    by_chance = Window.partitionBy("family").orderBy(F.xxhash64("doc_id"), "doc_id")
    shown = members.where("inside").withColumn("_nth", F.row_number().over(by_chance)).where(F.col("_nth") <= SHOWN)
    held = map_arrow(shown.join(texts, "doc_id").select("family", "text"), _sets(size), "family bigint, shingles array<bigint>")
    held = materialize(held, "shown")
    votes = held.select("family", F.explode("shingles").alias("shingle")).groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("n"))
    shows = held.groupBy("family").agg(F.count(F.lit(1)).alias("of"))
    centres = votes.join(shows, "family").where("2 * n > of").groupBy("family").agg(F.collect_list("shingle").alias("centre"))

    named = members.join(texts, "doc_id").select("family", "doc_id", "inside", "text")
    with_centre = lookup_join(named, centres, ["family"], spread=["doc_id"], how="inner")
    kind = "family bigint, doc_id bigint, inside boolean, slack bigint, deviations array<bigint>"
    rows = materialize(map_arrow(with_centre, _deviations(size, percent), kind), "deviations")

    inside = rows.where("inside")
    best = inside.groupBy("family").agg(
        F.min(F.struct("slack", "doc_id")).alias("best"), F.max(F.size("deviations")).alias("widest")
    )
    outside = lookup_join(rows.where("NOT inside"), best, ["family"], spread=["doc_id"], how="inner")
    both = F.col("slack") + F.col("best.slack")
    certain = outside.where(both <= 0).select(F.col("best.doc_id").alias("a"), F.col("doc_id").alias("b"))

    unit = 2 * (100 + percent)
    needs = F.ceil(both / F.lit(unit)).cast("int")
    open_ = outside.where(both > 0).select("family", "doc_id", "slack", "deviations", needs.alias("needs"), "widest")
    open_ = open_.where((F.col("needs") <= F.col("widest")) & (F.col("needs") <= F.size("deviations")))
    open_ = materialize(open_.withColumn("row", F.monotonically_increasing_id()), "outside")

    # A member needs as many as the least slack outside asks of it.
    least = open_.groupBy("family").agg(F.min("slack").alias("least"))
    able = lookup_join(inside, least, ["family"], spread=["doc_id"], how="inner")
    able = able.withColumn("needs", F.greatest(F.ceil((F.col("slack") + F.col("least")) / F.lit(unit)), F.lit(1)).cast("int"))
    able = able.where(F.col("needs") <= F.size("deviations")).withColumn("row", F.monotonically_increasing_id())
    asked = open_.select("family", "row", "doc_id", "needs", F.explode("deviations").alias("shingle"))
    offered = able.select("family", "row", "doc_id", "needs", F.explode("deviations").alias("shingle"))
    wanted = asked.select("family", "shingle").distinct()
    offered = _enough(lookup_join(offered, wanted, ["family", "shingle"], spread=["row"], how="left_semi"), "offered")
    uses = materialize(offered.groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("uses")), "uses")
    first = _prefix(asked, uses, "asked").select("family", "shingle", "row")
    second = _prefix(offered, uses, "given").select("family", "shingle", F.col("doc_id").alias("y"))
    reached = lookup_join(second, first, ["family", "shingle"], spread=["y"], how="inner", stored=True)
    pairs = materialize(reached.select("family", "row", "y").distinct(), "reached")
    left = lookup_join(
        pairs, open_.select("row", F.col("doc_id").alias("x"), F.col("slack").alias("slack_x"), F.col("deviations").alias("one")), ["row"],
        spread=["y"], how="inner", may_broadcast=False,
    )
    right = inside.select("family", F.col("doc_id").alias("y"), F.col("slack").alias("slack_y"), F.col("deviations").alias("two"))
    full = left.join(right, ["family", "y"])
    shared = F.size(F.array_intersect("one", "two"))
    linked = full.where(F.lit(unit) * shared >= F.col("slack_x") + F.col("slack_y"))
    return certain.unionAll(linked.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct()
