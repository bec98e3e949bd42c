"""Links between families of near copies and what lies outside of them, against brute force."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from scorewright.llm import parity_join
from scorewright.llm.families import family_links
from scorewright.llm.shingles import shingle_set, similar

TEXTS = "doc_id bigint, text string"


def family(rng, base, members, most):
    """Copies of a text with up to ``most`` words changed, some of the changes shared by several copies."""
    words = base.split()
    shared = [(int(rng.integers(len(words))), f"s{k}") for k in range(6)]
    for _ in range(members):
        copy = list(words)
        for _ in range(int(rng.integers(0, most + 1))):
            copy[int(rng.integers(len(copy)))] = f"x{rng.integers(10**6)}"
        for at, word in shared:
            if rng.random() < 0.15:
                copy[at] = word
        yield " ".join(copy)


def linked(texts, percent=75):
    sets = {i: shingle_set(t.encode() if t else None, 5) for i, t in texts.items()}
    return {(a, b) for a, b in combinations(sorted(texts), 2) if similar(sets[a], sets[b], percent)}


def groups(ids, pairs):
    label = {i: i for i in ids}
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label = {i: low if x == high else x for i, x in label.items()}
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_family_links_against_brute_force(spark, seed):
    """Sets near a family, far from it, alike only to one of its members, and empty; two families that share documents."""
    rng = np.random.default_rng(seed)
    base = " ".join(rng.choice([f"w{k}" for k in range(3000)], 150))
    other = " ".join(rng.choice([f"v{k}" for k in range(3000)], 60))
    texts = dict(enumerate([*family(rng, base, 60, 9), *family(rng, other, 30, 5)]))
    odd = next(family(rng, base, 1, 0)).split()
    odd[10:16] = ["odd"] * 6
    texts |= {500: " ".join(odd), 501: " ".join([*odd[:90], *["more"] * 3, *odd[90:]]), 502: "nothing like it at all here", 503: None, 504: ""}
    inside = {1: set(range(0, 25)) | {500}, 2: set(range(60, 80))}
    rows = [(f, i, i in inside[f]) for f in inside for i in texts if i % 4 or i in inside[f]]
    members = spark.createDataFrame(rows, "family bigint, doc_id bigint, inside boolean")
    held = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(3, texts[70])], TEXTS)
    got = {(min(r), max(r)) for r in map(tuple, family_links(members, held, size=5, percent=75).collect())}
    true = linked(texts) | {tuple(sorted((3, i))) for i in texts if i != 3 and (min(70, i), max(70, i)) in linked(texts) or i == 70}
    assert got <= true and got
    met = {(f, i) for f, i, _ in rows}
    for f, own in inside.items():
        for i in texts:
            if (f, i) in met and i not in own:
                links = {m for m in own if (min(i, m), max(i, m)) in true}
                found = {m for m in own if (min(i, m), max(i, m)) in got}
                assert bool(links) == bool(found) and found <= links, (f, i)


@pytest.mark.parametrize("least", [0, 3, 16])
def test_groups_with_families_of_any_size(spark, monkeypatch, least):
    """Families at the threshold and just below it; whole groups whatever counts as a family."""
    monkeypatch.setattr(parity_join, "FAMILY", least)
    rng = np.random.default_rng(9)
    texts = {}
    for k, (words, members, most) in enumerate([(120, 70, 9), (60, 40, 5), (300, 30, 22), (8, 20, 1)]):
        base = " ".join(rng.choice([f"{k}w{j}" for j in range(2000)], words))
        for text in family(rng, base, members, most):
            texts[len(texts)] = text
    docs = spark.createDataFrame(list(texts.items()), TEXTS)
    found, _ = parity_join.join_near(docs, rarity_bits=16)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == groups(texts, linked(texts))


def test_no_families(spark):
    members = spark.createDataFrame([], "family bigint, doc_id bigint, inside boolean")
    assert family_links(members, spark.createDataFrame([], TEXTS), size=5, percent=75).count() == 0
