import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture
def documents(spark):
    """A documents table of texts (or of (doc_id, text) pairs), with columns whose names clash with inner ones."""

    def made(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC_SCHEMA)
        for name in ("id", "component_id", "ids", "gram", "range", "score", "label", "spans", "key", "start"):
            df = df.withColumn(name, df.lang)
        return df

    return made
