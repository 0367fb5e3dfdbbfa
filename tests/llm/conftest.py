import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, extra int, score double, kind string"


@pytest.fixture
def documents(spark, tmp_path):
    """Write texts as a stored documents table, with columns whose names clash, and read it."""

    def make(texts, sources=("a",), ids=None):
        rows = [((ids or {}).get(i, i), t, "en", sources[i % len(sources)], len(t) if t is not None else None, 1, 0.5, "x") for i, t in enumerate(texts)]
        path = str(tmp_path / f"d{random.random()}")
        spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make
