"""Classifiers are fitted in a task: the driver neither collects the sample nor computes a step."""

import numpy as np

from strandframe.llm import labelled, mixing, quality


def test_driver_does_not_fit(spark, monkeypatch):
    rows = [(k, f"good words {k}" if k % 2 else "xx " * (k % 5), "en" if k % 3 else "de") for k in range(40)] + [(40, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(41)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", quality.FOLDS, quality.HELD, quality.TRAIN_ROWS)
    want = quality.ByteNet().fit([(r[1] or "").encode() for r in got], np.array([r[2] for r in got], np.float32))
    got = [r for r in labelled.sample(docs, labels, "quality", 1, -1, mixing.TRAIN_ROWS, ("lang",)) if r[3] is not None]
    domains = mixing.DomainModel().fit([(r[1] or "").encode() for r in got], [r[3] for r in got])

    def never(*args, **more):
        raise AssertionError("fitted on the driver")

    for kind in (quality.ByteNet, mixing.DomainModel):
        monkeypatch.setattr(kind, "fit", never)
    net, model = quality.train(docs, labels), mixing.train(docs, labels)
    assert all(np.allclose(net.p[k], want.p[k], atol=1e-3) for k in want.p)
    assert model.domains == domains.domains == ["de", "en"] and np.allclose(model.weights, domains.weights, atol=1e-5)
    monkeypatch.undo()
    assert quality.train(docs, labels.limit(0)).constant == 0.5 and mixing.train(docs, labels.limit(0)).domains == ["all"]
