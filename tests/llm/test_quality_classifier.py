import zlib

import numpy as np

from lexloom.llm import quality_classifier as Q


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for s in np.unique(scores):
        ranks[scores == s] = ranks[scores == s].mean()
    k = labels.sum()
    return (ranks[labels == 1].sum() - k * (k + 1) / 2) / (k * (len(labels) - k))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = Q.score(docs, Q.fit(docs, labels)).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").toPandas()
    assert ((scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)) == scored.held_out).all()
    held = scored[scored.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.95
    assert (held.predicted == held.quality).mean() > 0.93
    assert held[held.quality == 1].predicted.mean() > 0.95


def test_held_out_labels_are_never_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a = {r.doc_id: r.score for r in Q.score(docs, Q.fit(docs, labels)).collect()}
    b = {r.doc_id: r.score for r in Q.score(docs, Q.fit(docs, turned)).collect()}
    assert a == b


def test_edges(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = Q.score(documents, Q.fit(documents, labels))
    assert {r.score for r in scored.collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, None) for i in range(100)] + [(None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.score(documents, Q.fit(documents, one)).collect()} == {1.0}
    real = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = Q.fit(documents, real)
    scored = Q.score(documents.withColumn("score", documents.doc_id), model).collect()
    assert len(scored) == documents.count() and all(0 <= r.score <= 1 for r in scored)
    assert Q.score(documents.where("false"), model).count() == 0


def test_isotonic_pools_violators():
    x, y = Q.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [0, 1.5, 3]
