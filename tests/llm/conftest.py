import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table of texts, or of (doc_id, text) or (doc_id, text, lang) rows."""

    def make(*rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            doc, text, lang = (*r, "en")[:3]
            full.append((doc, text, lang, "s", len(text) if text is not None else None))
        return spark.createDataFrame(full, DOCS)

    return make


def clashing(df):
    """df with further columns named like ones that operators use inside."""
    from pyspark.sql import functions as F

    names = ["fp", "h", "kind", "bucket", "blob", "sub", "doc", "f", "v", "cell", "depth", "prefix", "row_bytes", "shard", "component", "least", "spans", "kept", "host", "path", "rule", "parts", "pos", "start"]
    return df.withColumns({n: F.lit(7) for n in names if n not in df.columns})
