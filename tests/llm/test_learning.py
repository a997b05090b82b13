"""Co-training that learns from unlabelled rows, its odd labels, and exact counts of repeated rows in the line index."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import linededup, quality

SF = "/root/testdata/sf0.01"


def test_few_labels_gain_from_unlabelled_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    known, test = labels.where(~apart).orderBy(F.xxhash64("doc_id")).limit(60), docs.join(labels.where(apart), "doc_id").where("quality is not null").toPandas()
    y, said = test["quality"].to_numpy(float), {}
    for rounds in (0, 3):
        model = quality.train(docs, known, rounds=rounds)
        p = model(*quality._views(test)).clip(1e-9, 1 - 1e-9)
        said[rounds] = ((p > 0.5) == y).mean(), -np.where(y > 0, np.log(p), np.log(1 - p)).mean()
    assert said[3][0] > said[0][0] + 0.15 and said[3][1] < said[0][1] - 0.2 and said[3][0] > 0.9
    assert [r for r, _, _ in model.exchanged] == [1, 2, 3]
    sizes = [(a, b) for _, a, b in model.exchanged]
    assert all(a > 50 and b > 50 for a, b in sizes) and sizes == sorted(sizes) and sizes[-1][0] > 2 * sizes[0][0]


def test_many_labels_lose_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    got = quality.scores(docs, labels.where(~apart)).join(labels.where(apart & F.col("quality").isNotNull()), "doc_id").toPandas()
    assert (got.keep == (got.quality == 1)).mean() > 0.98


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("labels,want", [([], 0.5), ([(1, 1), (2, 1), (3, 1)], None), ([(1, 0), (1, 1), (2, None)], None), ([(None, 1), (9, 5)], 0.5)])
def test_labels_of_every_kind_give_scores(spark, labels, want):
    docs = spark.createDataFrame([(i, "word " * i, "en", None, i) for i in range(1, 8)] + [(None, None, None, None, None), (3, "word " * 3, "en", None, 3)], DOCS)
    got = quality.scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    if want is not None:
        assert all(abs(r["score"] - want) < 1e-9 for r in got)
    if len(labels) == 3 and labels[0][1] == 1:
        assert all(r["score"] > 0.5 for r in got)
    same = [r["score"] for r in got if r["doc_id"] == 3]
    assert same[0] == same[1]


def test_repeated_rows_count_once_in_the_line_index(spark):
    kind = "doc_id long, text string"
    rows = [(1, "a line that is long enough\nanother line that is long"), (1, "a line that is long enough"), (2, "a line that is long enough"), (2, "a line that is long enough")]
    refs = lambda index: {(r["refs"], r["owner"]) for r in index.refs.collect()}
    built = linededup.LineIndex.build(spark.createDataFrame(rows, kind))
    grown = linededup.LineIndex.build(spark.createDataFrame(rows[:1], kind)).insert(spark.createDataFrame(rows[1:], kind))
    assert refs(built) == refs(grown) == {(2, 1)}
    assert refs(grown.delete(spark.createDataFrame([(2,)], "doc_id long"))) == set()
