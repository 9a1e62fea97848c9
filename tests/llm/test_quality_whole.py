"""The classifier learns from all labelled documents, whatever their number."""

import numpy as np
import pytest

from trackframe.llm import quality


@pytest.fixture(scope="module")
def corpus(spark):
    words = "alder birch cedar fir hazel larch maple oak pine rowan".split()
    texts = [(k, " ".join(words[(k * j) % 10] for j in range(1, 9)) + (" foul" if k % 3 == 0 else " fine")) for k in range(240)]
    labels = [(k, int(k % 3 != 0), int(k % 6 == 0)) for k in range(240)]
    return spark.createDataFrame(texts, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_every_labelled_document_counts(spark, corpus, monkeypatch):
    """The bound on what one task fits is no bound on what is learnt: without the documents beyond it the model is another."""
    for name in ("PART", "SAMPLE"):
        monkeypatch.setattr(quality, name, 60, raising=False)
    docs, labels = corpus
    first = labels.selectExpr("*", "xxhash64(doc_id) AS h").orderBy("h").limit(60).drop("h")
    (w, cut), (w60, cut60) = quality.train(docs, labels), quality.train(docs, first)
    assert not np.allclose(cut, cut60) or not np.allclose(w, w60)


def test_parts_agree_with_the_whole(spark, corpus, monkeypatch):
    """Documents that one fit tells apart are told apart by the mean of parts, whichever way labels are joined."""
    docs, labels = corpus
    monkeypatch.setattr(quality, "PART", 60)
    monkeypatch.setattr(quality, "FEW_LABELS", 0)
    got = {r.doc_id: r.keep for r in quality.classify(docs, labels).collect()}
    assert got == {k: k % 3 != 0 for k in range(240)}
