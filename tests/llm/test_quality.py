import numpy as np

from urna.llm import quality, queries
from urna.llm.common import read


def test_held_out_rows_are_told_apart(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op5_quality_classifier(spark, folder).join(read(spark, folder, "labels"), "doc_id").where("held_out").toPandas()
    right = (rows.predicted == rows.quality).mean()
    assert len(rows) > 50 and right > 0.97, right
    order = rows.score.rank()
    good, bad = order[rows.quality == 1], order[rows.quality == 0]
    auc = (good.sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.99, auc


def test_split_follows_the_checksum(spark, small):
    import zlib

    for r in queries.op5_quality_classifier(spark, small).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_held_out_labels_are_never_learnt_from(spark, small):
    from pyspark.sql import functions as F

    docs, labels = read(spark, small, "documents"), read(spark, small, "labels")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, labels), quality.fit(docs, turned))


def test_odd_texts(spark, odd_docs, no_docs, small):
    docs, labels = read(spark, small, "documents"), read(spark, small, "labels")
    weights = quality.fit(docs, labels)
    rows = quality.score(odd_docs, weights).collect()
    assert len(rows) == odd_docs.count()
    by_id = {}
    for r in rows:
        assert 0 < r.score < 1
        by_id.setdefault(r.doc_id, []).append(r.score)
    assert by_id[1] == by_id[2] == by_id[3] and by_id[0] == by_id[7] and len(set(by_id[13])) == 1
    assert quality.score(no_docs, weights).count() == 0
    nothing = quality.fit(docs, labels.limit(0))
    assert not nothing.any() and quality.score(docs, nothing).where("score = 0.5").count() == docs.count()
