"""Ranked search, SimHash groups and centroids against brute force, on edge rows and on empty tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from scorewright.llm import centroids, lexical_search, queries, simhash
from scorewright.llm.common import pieces

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, fp string, query string"
NEW = ("op11_ranked_search", "op12_simhash", "op13_centroid_clustering")


def to_docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", None, None, 7, "x", "y") for i, t in rows], DOCS)


def test_pieces_cut_no_word():
    text = b"alpha beta  gamma\ndelta " * 50 + b"x" * 300
    cut = list(pieces(text, size=64))
    assert b"".join(cut) == text and len(cut) > 5
    assert [word for piece in cut for word in piece.split()] == text.split()


# Ranked search


def terms_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_search(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [c.total() for _, c in held]
    n_docs, total = sum(1 for n in sizes if n), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    rows = []
    for item, text in items:
        found = []
        for (doc, counts), n in zip(held, sizes):
            score = 0
            for term in set(terms_of(text)):
                if counts[term]:
                    m = 50 + (50 * n * n_docs) // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((1_000_000_000 * counts[term]) // (1000 * counts[term] + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        rows += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(rows, key=str)


def worded(seed, n, words, longest):
    rng = np.random.default_rng(seed)
    bank = [f"t{k}" for k in range(words)]
    shares = 1 / np.arange(1, words + 1)
    return [(int(i), " ".join(rng.choice(bank, int(rng.integers(0, longest)), p=shares / shares.sum()))) for i in range(n)]


def test_search_edges(spark):
    docs = worded(1, 400, 60, 40) + [
        (900, None), (901, ""), (902, " .,; "), (None, "t3 T4 t5"), (None, "t3 T4 t5"), (903, "t3 t4,t5"), (903, "t3 t4 t5"),
        (904, "é日本 T1-t2/t3 " * 30_000),
    ]
    items = [(1, "t1 t2, T3 unheard"), (2, None), (3, ""), (1, "t1 t2 t3"), (4, "é日本"), (5, "unheard"), (None, "t50 t51 t3 t4 t5")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id bigint, text string, rank int, terms int")
    for blocks in (100_000, 3):
        got = lexical_search.search(to_docs(spark, docs), asked, k=7, block_terms=blocks)
        assert sorted([tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()], key=str) == brute_search(docs, items, 7)


def test_search_over_many_tasks(spark):
    docs = worded(2, 3000, 200, 60) + [(5000 + i, "t7 t9 t30 t31") for i in range(700)]
    items = [(i, t) for i, t in worded(3, 12, 200, 30)] + [(99, "t7 t31")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = lexical_search.search(to_docs(spark, docs).repartition(9), asked, k=50)
    assert sorted([tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()], key=str) == brute_search(docs, items, 50)


@pytest.mark.parametrize("seed", range(4))
def test_ball_bounds_hold_and_prune(seed):
    rng = np.random.default_rng(seed)
    rows = (rng.random((500, 40)) < 0.15) * rng.integers(1, 10**6, (500, 40))
    rows[100:300] = rows[7]
    weights = rng.integers(0, 20_000, 40)
    asked = (rng.random((40, 9)) < 0.3) * weights[:, None]
    tree = lexical_search.BallTree(rows, leaf=8)
    assert sorted(tree.order.tolist()) == list(range(500)) and (tree.rows == rows[tree.order]).all()
    scores, bounds = tree.rows @ asked, tree.bounds(asked.astype(float))
    for (start, stop), bound in zip(tree.spans, bounds):
        assert (scores[start:stop].max(axis=0) <= bound).all()
    leaves = sum(children is None for children in tree.children)
    best = [lexical_search._Best(5, 1) for _ in range(9)]
    opened = lexical_search._search_tree(tree, tree.order.tolist(), [np.flatnonzero(q) for q in asked.T], weights, best)
    assert 0 < opened < 9 * leaves
    for held, q in zip(best, asked.T):
        want = sorted((-int(s), i) for i, s in zip(tree.order.tolist(), tree.rows @ q) if s > 0)[:5]
        assert sorted((s, i) for s, _, i in held.held) == want


def test_large_matrices_are_cut(monkeypatch):
    monkeypatch.setattr(lexical_search, "CELLS", 50)
    offsets, terms = np.arange(0, 101, 5), np.arange(100) % 33
    cut = sorted(lexical_search._blocks(20, offsets, terms))
    assert [a for a, _ in cut] == [0, *[b for _, b in cut[:-1]]] and cut[-1][1] == 20
    assert all(b - a == 1 or (b - a) * len(np.unique(terms[offsets[a] : offsets[b]])) <= 50 for a, b in cut)


# SimHash


def plain_fingerprint(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    parts = [b" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id per row's component; rows are (id, fingerprint)."""
    label = list(range(len(prints)))
    for a, b in combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    least = {}
    for (doc, _), x in zip(prints, label):
        if doc is not None:
            least[x] = min(least.get(x, doc), doc)
    return [least.get(x) for x in label]


def test_masks_cover_all_pairs_of_bits():
    tables = simhash.masks(2)
    assert len(tables) == 7
    for a, b in combinations(range(64), 2):
        assert any(not mask >> a & 1 and not mask >> b & 1 for mask in tables)


def test_spark_hashes_alike(spark):
    row = spark.sql("SELECT xxhash64('one two three') AS h").first()
    assert row["h"] % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_fingerprints_of_pieces(monkeypatch, piece):
    monkeypatch.setattr(simhash, "pieces", lambda text: pieces(text, size=piece))
    monkeypatch.setattr(simhash, "COUNTED", 5)
    for text in [None, "", " \n", "One", "one\ttwo", "a b c", "Ä b  c D " * 40, "word " * 300, "x" * 500 + " y z w"]:
        assert simhash.fingerprint(text.encode() if text else None) == plain_fingerprint(text), text


def test_groups_edges(spark):
    rng = np.random.default_rng(5)
    base = "the quick brown fox jumps over a lazy dog while seven wizards watch from that quiet hill nearby ".split() * 30
    rows = [(None, None), (3, ""), (2, " \t"), (None, "lone words here"), (4, "lone words here"), (4, "lone words here"), (None, "nobody else")]
    for k in range(60):
        copy = list(base)
        for _ in range(int(rng.integers(0, 4))):
            copy[int(rng.integers(len(copy)))] = f"w{rng.integers(9)}"
        rows.append((100 + k, " ".join(copy)))
    rows.append((7, "Zoë É ß 日本 " * 5000))
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{fp:016x}", c) for (i, fp), c in zip(prints, brute_components(prints))), key=str)
    got = simhash.group_near(to_docs(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == want
    assert len({c for _, _, c in want}) < len(want) - 20


@pytest.mark.parametrize("together", [1, 16, 10**6])
def test_links_join_what_is_near(spark, together):
    """Chains, dense balls around one string and lone strings, all by shared strings, mixed, and all by pairs."""
    rng = np.random.default_rng(together)
    prints = {int(x) for x in rng.integers(0, 2**63, 40)}
    for centre in rng.integers(0, 2**63, 3).tolist():
        at = int(centre)
        prints |= {at ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))}
        for _ in range(20):
            at ^= (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
            prints.add(at)
    prints = sorted(prints)
    table = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp bigint")
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(table, together=together).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    assert len(found) == len(set(found)) <= 30 * len(prints)
    label = {p: p for p in prints}
    for a, b in found:
        low, high = sorted((label[a], label[b]))
        label = {p: low if x == high else x for p, x in label.items()}
    assert [label[p] for p in prints] == brute_components([(p, p) for p in prints])


# Centroids


def brute_clusters(vectors, clusters=8, rounds=10):
    order = sorted(range(len(vectors)), key=lambda i: (hashlib.sha256(f"3:{'' if vectors[i][0] is None else vectors[i][0]}".encode()).hexdigest(), vectors[i][1]))
    middle = [list(vectors[i][1]) for i in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middle))

    for _ in range(rounds):
        held = [nearest(v)[1] for _, v in vectors]
        for c in set(held):
            own = [v for (_, v), x in zip(vectors, held) if x == c]
            middle[c] = [sum(column) // len(own) for column in zip(*own)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in vectors], middle


def to_rows(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "z") for i, v in rows], "vec_id bigint, embedding array<float>, label int, cluster int, id string")


def test_clusters_edges(spark):
    rng = np.random.default_rng(4)
    grid = [(i, [float(x) / 4 for x in rng.integers(-2, 3, 64)]) for i in range(150)]
    bad = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [float("nan")] + [0.0] * 63),
           (205, [float("inf")] + [0.0] * 63), (206, [None] + [0.0] * 63)]
    rows = grid + bad + [(7, grid[7][1]), (None, [0.25] * 64), (300, [100_000.0] + [0.0] * 63)]
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if (i, v) not in bad]
    assigned, middle = centroids.cluster(to_rows(spark, rows).repartition(5))
    want, want_middle = brute_clusters(usable)
    assert middle == want_middle
    assert sorted([tuple(r) for r in assigned.collect()], key=str) == sorted(want, key=str)
    full = centroids.with_inertia(assigned, middle).collect()
    assert {r["inertia"] for r in full} == {sum(d for _, _, d in want)}
    assert all(r["centroid_sha256"] == centroids.digest(want_middle[r["cluster"]]) for r in full)


def test_few_and_large_vectors(spark):
    few = to_rows(spark, [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-1.0] * 64)])
    assigned, middle = centroids.cluster(few)
    got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in assigned.collect()}
    assert len(middle) == 3 and got[1] == got[2] and got[1][1] == got[3][1] == 0
    with pytest.raises(Exception, match="component beyond"):
        centroids.cluster(to_rows(spark, [(1, [1e30] * 64)]))


@pytest.mark.parametrize("seed", range(6))
def test_vantage_tree_keeps_ties(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-2, 3, (60, 3)) if seed % 2 else rng.integers(-(10**7), 10**7, (60, 3))
    points = np.concatenate([points, points[5:15]])
    asked = rng.integers(-3, 4, (500, 3)) if seed % 2 else rng.integers(-(10**7), 10**7, (500, 3))
    who, best = centroids.VantageTree(points).nearest(asked)
    apart = ((asked[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (who == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


@pytest.mark.parametrize("name", NEW)
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "benchmark", "embeddings"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    assert got.count() == 0
    assert got.schema.simpleString() == queries.QUERIES[name](spark, SMALL).schema.simpleString()
