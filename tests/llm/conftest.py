import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, schema=SCHEMA):
        """Rows (doc_id, text[, lang, source]) as a documents table."""
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def clashing():
    """Add columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def add(df):
        for name in ("p", "node", "component", "component_id", "kept", "size", "slot", "key", "d", "chain", "bucket", "label_",
                     "score", "new_text", "rank", "row", "v", "times", "target", "n", "id", "doc", "cut", "i"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return add
