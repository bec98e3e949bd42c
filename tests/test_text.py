"""Document operators on written fixtures and against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from scorewright import scale
from scorewright.operators import text as ops

RECIPE = """\
Oven
Heat it on 12 March 2023 or 2024-06-30. Then wait! The bill of $75 went to baker@bread.example.net.

Dough
Knead for an hour. Flour from Golden Mill GmbH is €2,310.40 a ton since May 2021.

Crust
Ask Rosa Quill at 172.16.4.9 about it."""

NOTES = """\
an unlabelled start
over two lines

Watering: Each bed gets
two cans. Cacti get none.

Pruning: Cut in March only."""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")


def test_entities(spark):
    found = ops.entity_lists(docs(spark, RECIPE, "nothing"), "id", "text", names=["Rosa Quill", "Bo Finch"])
    lists = {}
    for row in found.collect():
        assert row["id"] == 0
        lists.setdefault(row["entity_type"], set()).add(row["entity"])
    assert lists == {
        "date": {"12 March 2023", "2024-06-30", "May 2021"},
        "money": {"$75", "€2,310.40"},
        "email": {"baker@bread.example.net"},
        "ipv4": {"172.16.4.9"},
        "organisation": {"Golden Mill GmbH"},
        "person": {"Rosa Quill"},
    }


def test_entities_are_listed_once(spark):
    twice = ops.entity_lists(docs(spark, "a@b.io and a@b.io", "a@b.io"), "id", "text")
    assert ops.count_entities(twice).first()["n_docs"] == 2 and twice.count() == 2


def test_outline_of_headed_text(spark):
    got = {r["heading"]: r["lead"] for r in ops.outline_text(docs(spark, RECIPE), "id", "text").collect()}
    assert got == {
        "Oven": "Heat it on 12 March 2023 or 2024-06-30.", "Dough": "Knead for an hour.",
        "Crust": "Ask Rosa Quill at 172.16.4.9 about it.",
    }


def test_long_headings_are_headings(spark):
    heading = "A heading of a great many words " * 5 + "in all"
    got = ops.outline_text(docs(spark, f"{heading}\nFirst one. Second."), "id", "text").first()
    assert (got["heading"], got["lead"]) == (heading, "First one.")


def test_outline_of_labelled_text(spark):
    got = {r["heading"]: r["lead"] for r in ops.outline_text(docs(spark, NOTES), "id", "text").collect()}
    assert got["Watering"] == "Each bed gets two cans."
    assert got["Pruning"] == "Cut in March only."


def test_outline_of_html(spark):
    html = '<script>"</p>"</script><h1 class="x">A <b>big</b> title</h1><nav/><p>First one. Second.<p>Third.'
    row = ops.outline_html(docs(spark, html, "<p>no heading</p>"), "text").orderBy("id").collect()
    assert (row[0]["heading"], row[0]["lead"]) == ("A big title", "First one.")
    assert (row[1]["heading"], row[1]["lead"]) == ("", "")


def test_summary_is_verbatim_and_in_order(spark):
    text = "Edge nodes keep data near. Cats sleep. Edge nodes save data and edge nodes save time! Bye now. Data moves less."
    got = ops.extractive_summary(docs(spark, text, "", "One only.", None), "id", "text", k=2)
    rows = {r["id"]: r for r in got.collect()}
    assert rows[0]["summary"] == "Edge nodes keep data near. Edge nodes save data and edge nodes save time!"
    assert rows[0]["n_sentences"] == 5 and rows[0]["n_chosen"] == 2
    assert rows[1]["summary"] == "" and rows[2]["summary"] == "One only."
    assert set(rows) == {0, 1, 2, 3}


def test_summary_against_brute_force(spark):
    """Ids that are missing or shared, sentences without words, ties, no words at all; no word leaves its row."""
    chance = random.Random(4)
    words = ["a", "B", "c", "É", "é", "dd", "7", "--", "..."]
    texts = ["".join(chance.choice(words) + chance.choice([" ", ", ", ". ", "! ", "?\n"]) for _ in range(chance.randrange(60))) for _ in range(150)]
    rows = [(chance.choice([None, 1, 1, i]), text) for i, text in enumerate([*texts, None, "", "- ... -"])]
    frame = spark.createDataFrame(rows, "id INT, body STRING")
    got = ops.extractive_summary(frame, "id", "body", k=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, body in rows:
        sentences = [s.strip() for s in regex.split(r"(?<=[.!?])\s+", body or "") if s.strip()]
        held = [[w for w in regex.split(r"[^\p{L}\p{N}]+", s.lower()) if w] for s in sentences]
        tf = Counter(w for own in held for w in own)
        best = sorted((-sum(tf[w] for w in own) / len(own), at) for at, own in enumerate(held) if own)[:2]
        chosen = [sentences[at] for at in sorted(at for _, at in best)]
        want.append((i, None if body is None else len(sentences), len(chosen), " ".join(chosen)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert plan.count("Exchange") == 1 and not any(step in plan for step in ("Join", "Aggregate", "Generate", "Sort "))


def test_word_frequency(spark):
    got = {r["word"]: r["n"] for r in ops.word_frequency(docs(spark, "It's  it, IT!", "été-ÉTÉ 42", None), "text").collect()}
    assert got == {"it": 3, "s": 1, "été": 2, "42": 1}


def test_classify(spark):
    labels = {"hr": ["leave", "staff"], "finance": ["invoice", "tax"], "legal": ["court"]}
    got = ops.classify(docs(spark, "Staff leave tax", "Invoice, court", "none of it", None), "text", labels)
    assert [r["predicted"] for r in got.orderBy("id").collect()] == ["hr", "finance", "unknown", "unknown"]


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_retrieval_against_brute_force(spark, monkeypatch, k, seed):
    """Common words in nearly all passages, rare ones in few; many ties; some questions find little."""
    monkeypatch.setattr(ops, "PASSAGES_AT_ONCE", 7)
    chance = random.Random(seed)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(40)]

    def text():
        return " ".join(chance.sample(common, 4) + chance.sample(rare, chance.randrange(4)))

    copy, twin = text(), text()
    passages = [(i, copy if i % 3 == 0 else text()) for i in range(80)]
    questions = [(i, twin if i % 3 == 0 else text()) for i in range(15)]
    questions += [(15, "unseen words"), (16, ""), (17, "r1 unseen"), (18, "c0"), (19, copy)]
    got = ops.retrieve_passages(
        spark.createDataFrame(questions, "q INT, text STRING"), "q", spark.createDataFrame(passages, "p INT, text STRING"), "p", "text", k=k, block_words=100_000 if seed == 1 else 30
    )
    found = {(r["q"], r["rank"]): (r["p"], r["n_shared"]) for r in got.collect()}
    want = {}
    for q, asked in questions:
        scored = [(-len(set(asked.split()) & set(t.split())), p) for p, t in passages]
        for rank, (score, p) in enumerate(sorted(s for s in scored if s[0] < 0)[:k], 1):
            want[q, rank] = (p, -score)
    assert found == want


@pytest.mark.parametrize("broadcast", [True, False])
def test_dictionary_against_brute_force(spark, monkeypatch, broadcast):
    """Names that begin alike, overlap, repeat, stand at the ends, have marks inside or no words at all."""
    if not broadcast:
        monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    chance = random.Random(12)
    words = ["Ada", "ada", "Van", "der", "Berg", "O", "Neil", "Zoë", "7"]
    names = {" ".join(chance.choices(words, k=chance.randrange(1, 5))) for _ in range(25)} | {"O'Neil", "Van-der Berg", "...", ""}
    docs = [(i, chance.choice([" ", ", ", "\n"]).join(chance.choices(words + ["the"] * 9, k=chance.randrange(0, 30)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "Ada"), (502, "Ada"), (503, "Ada " * 3000)]
    table = spark.createDataFrame([(n,) for n in sorted(names)] * 2 + [(None,)], "name STRING")
    got = ops.dictionary_entities(spark.createDataFrame(docs, "id INT, body STRING"), "id", "body", table).collect()

    def tokens(text):
        return [w for w in regex.split(r"[^\p{L}\p{N}]+", text or "") if w]

    want = set()
    for i, body in docs:
        held = tokens(body)
        for name in names:
            own = tokens(name)
            if own and any(held[k : k + len(own)] == own for k in range(len(held))):
                want.add((i, "person", name))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_dictionary_of_a_million_names(spark):
    names = spark.range(1_000_000).select(F.concat(F.lit("n"), F.col("id") % 5000, F.lit(" of m"), F.col("id")).alias("name"))
    docs = spark.createDataFrame([(1, "so n7 of m7, n7 of m8 and n9 of"), (2, "n4999 of m999999"), (3, "nobody")], "id INT, body STRING")
    got = ops.dictionary_entities(docs, "id", "body", names)
    assert sorted((r["id"], r["entity"]) for r in got.collect()) == [(1, "n7 of m7"), (2, "n4999 of m999999")]
