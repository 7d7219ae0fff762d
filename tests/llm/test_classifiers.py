"""Classifiers: held-out accuracy, odd rows, and that they learn from texts and allowed labels only."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs
from pyspark.sql import functions as F

from crosslume.llm import labelled, language, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n", "1234 ...", "x", "é" * 4000, "word " * 3000]


@pytest.fixture(scope="module")
def some(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def held(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_language_of_held_out_documents(spark, some):
    model = language.fit(some, labelled.fold("doc_id", 4) != 2)
    rows = language.predict(some, model).collect()
    own = [r for r in rows if held(r["doc_id"], 4) == 2 and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == r["lang"] for r in own) / len(own) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    # Labels of held-out rows change nothing, nor do lang and source of the rows that are judged.
    wrong = some.withColumn("lang", F.when(labelled.fold("doc_id", 4) == 2, "xx").otherwise(F.col("lang")))
    again = language.fit(wrong, labelled.fold("doc_id", 4) != 2)
    assert again.languages == model.languages and (again.weights == model.weights).all()
    odd = language.predict(docs(spark, ODD), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd[:4]] == ["und"] * 4 and odd[4]["lang_pred"] in model.languages
    nothing = language.fit(some.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(docs(spark, ODD), nothing).collect()} == {"und"}
    assert language.predict(some.limit(0), model).count() == 0


def accuracy(rows, label, folds, fold):
    own = [r for r in rows if held(r["doc_id"], folds) == fold]
    share = lambda v: [r["predicted"] == v for r in own if r[label] == v]
    return [sum(x) / len(x) for x in (share(0), share(1))]


def test_quality_of_held_out_documents(spark, some, labels):
    net = quality.fit(some, labels)
    rows = quality.with_score(some, net).join(labels, "doc_id").collect()
    bad, good = accuracy(rows, "quality", 5, 0)
    assert bad > 0.7 and good > 0.95
    odd = quality.with_score(docs(spark, [*ODD, "same text", "same text"]), net).orderBy("doc_id").collect()
    assert odd[0]["score"] == odd[1]["score"] and odd[-1]["score"] == odd[-2]["score"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in odd)
    # A text has its score wherever it stands in a batch.
    alone = quality.score(net, pa.array(["same text"]))[0]
    assert alone == pytest.approx(odd[-1]["score"], abs=1e-6)
    left = quality.clean(some, labels)
    assert left.columns == some.columns and 0.7 * some.count() < left.count() < some.count()


def test_toxicity_of_held_out_documents(spark, some, labels):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(big, known)
    rows = toxicity.with_score(big, model).join(known, "doc_id").collect()
    clean, toxic = accuracy(rows, "toxic", 4, 2)
    assert clean > 0.85 and toxic > 0.75
    odd = toxicity.with_score(docs(spark, ODD), model).orderBy("doc_id").collect()
    assert odd[0]["score"] == odd[1]["score"] == odd[2]["score"] < 0.3


def renamed(texts, names):
    """The texts with every word of ``names`` under another name."""
    import re

    other = {w: "zq" + w[::-1] + "xk" for w in names}
    return [re.sub(r"\w+", lambda m: other.get(m[0].lower(), m[0]), t or "") for t in texts]


def test_toxicity_does_not_hang_on_given_words(spark):
    some = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").toPandas()
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    rows = some.merge(known, on="doc_id").drop_duplicates("doc_id")
    in_toxic = {w for t in rows[rows.toxic == 1].text for w in set((t or "").lower().split())}
    ordinary = {w for t in rows[rows.toxic == 0].text for w in set((t or "").lower().split())}
    rows["text"] = renamed(rows.text, {w for w in in_toxic - ordinary if w.isalpha()})
    aside = rows.doc_id.map(lambda i: held(i, 4)) == 2
    model = toxicity.train(pa.table({"text": pa.array(rows[~aside].text), "label": pa.array(rows[~aside].toxic.astype("int32"))}))
    own = rows[aside]
    score = toxicity.score(model, toxicity.Distance(model.ordinary, model.toxic), pa.array(own.text))
    assert (score[own.toxic == 1] >= 0.3).mean() > 0.7 and (score[own.toxic == 0] < 0.3).mean() > 0.9


def plain_toxicity(model, text):
    """The score of one text, window by window."""
    import re
    import zstandard

    found = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    pair = []
    for content in (model.ordinary, model.toxic):
        held_ = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        options = {"write_content_size": False, "write_dict_id": False, "write_checksum": False}
        pair.append(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held_, **options))
    odds = []
    for i in range(0, len(found), toxicity.WINDOW):
        window = (" " + " ".join(found[i : i + toxicity.WINDOW]) + " ").encode()
        a, b = (len(c.compress(window)) for c in pair)
        odds.append(model.odds[min(max(a - b, toxicity.LOW), toxicity.HIGH) - toxicity.LOW])
    n, total = max(len(odds), 1), sum(odds)
    x = [np.clip(total / n**0.5, -5, 5), np.clip(total, -10, 20), np.clip(total / n, -2, 2), max(odds, default=0), np.log(n), 1]
    return 1 / (1 + np.exp(-(np.array(x) @ model.layer)))


def test_scores_equal_plain_ones(some, labels):
    rows = some.join(labels, "doc_id").toPandas().drop_duplicates("doc_id")
    texts = [*rows.text.fillna("").head(60), *[t or "" for t in ODD]]
    model = toxicity.train(pa.table({"text": pa.array(rows.text), "label": pa.array(rows.toxic.astype("int32"))}))
    score = toxicity.score(model, toxicity.Distance(model.ordinary, model.toxic), pa.array(texts))
    assert score == pytest.approx([plain_toxicity(model, t) for t in texts], abs=1e-9)


def test_fitting_without_labels(spark, some, labels):
    none = labels.limit(0)
    assert toxicity.with_score(docs(spark, ODD), toxicity.fit(some, none)).count() == len(ODD)
    assert {r["predicted"] for r in quality.with_score(docs(spark, ODD), quality.fit(some, none)).collect()} == {1}


def test_samples_are_bounded_and_leave_out_a_fold(spark, some, labels):
    held_out = labelled.fold("doc_id", 5) == 0
    def sample(known):
        return labelled.labelled_sample(some, known, "quality", held_out, {0: 10, 1: 25}).toArrow().sort_by("doc_id")

    table = sample(labels)
    counts = table.column("label").to_pylist()
    assert counts.count(0) <= 10 and counts.count(1) <= 25 and counts.count(1) > 15
    texts = {r["text"] for r in some.where(~held_out).collect()}
    assert set(table.column("text").to_pylist()) <= texts
    doubled = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None)], labels.schema))
    assert sample(doubled).equals(table)
