"""Input columns that are named like what the operators add or use on the way."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scorewright.llm import decontaminate, language_id, mixing, parity_join, quality, toxicity

NAMES = (
    "score lang_pred predicted features _dense _chance _score probability target taken repeats source_size _order _bin _whole _want _more "
    "n_words n_hit item_ids text_hash kept base_failed component_id n_shingles bucket node label _hash _node least"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"the cat and the dog number {i} sat on a mat near the old wall of the town " * 3, "en", "ab"[i % 2], 9) for i in range(40)]
    rows += [(100 + i, f"le chat et le chien numero {i} sont dans la maison pres de la ville ancienne " * 3, "fr", None, 9) for i in range(40)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return plain, plain.withColumns({name: F.lit("clash") for name in NAMES})


def same(plain, clash):
    columns = [name for name in plain.columns if name not in NAMES or dict(plain.dtypes)[name] == dict(clash.dtypes)[name]]
    assert len(clash.columns) == len(set(clash.columns)) and set(plain.columns) <= set(clash.columns)
    rows = [sorted(map(str, df.select(columns).collect())) for df in (plain, clash)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("name", ["mix", "language", "toxicity", "items", "quality", "groups", "first"])
def test_clashing_columns(docs, name):
    def run(df):
        if name == "mix":
            return mixing.mix_sources(df.withColumn("size", F.size(F.split("text", " ")).cast("bigint")))
        if name == "language":
            return language_id.identify(df, language_id.train(df.select("lang", "text")))
        if name == "toxicity":
            return toxicity.fit(df, df.limit(0).selectExpr("doc_id", "1 AS toxic")).score(df)
        if name == "items":
            return decontaminate.find_items(df, df.limit(3).select(F.col("doc_id").alias("item_id"), "text"))
        if name == "quality":
            return quality.assess(df)
        if name == "groups":
            return parity_join.join_near(df, rarity_bits=12)[0]
        return parity_join.first_of_groups(df, rarity_bits=12)

    same(*map(run, docs))
