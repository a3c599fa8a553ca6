from __future__ import annotations

import numpy as np

from tripline.llm import quality


def test_words_are_learned_from_all_texts(spark, documents):
    rows = [(n, f"common river word{n % 2}") for n in range(10)]
    rows += [(100 + n, "common unlabelled stone") for n in range(5)]
    labels = spark.createDataFrame([(n, n % 2) for n in range(10)], "doc_id long, quality int")
    model = quality.learn(documents(rows), labels)
    places, signs = quality.index_vectors()
    for word in ("common", "river", "word0", "word1", "unlabelled", "stone"):
        row = quality.row_of(word)
        own = np.zeros(quality.DIMENSIONS)
        own[places[row]] = signs[row]
        assert not np.allclose(model.vectors[row], own / np.linalg.norm(own), atol=0.01)
    assert model.network is not None and len(model.vectors) == len(quality.SIGNS) + quality.ROWS
