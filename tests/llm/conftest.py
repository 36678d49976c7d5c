import pytest
from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """make_docs([(doc_id, text), ...], **extra columns' constants): a table like documents."""

    def make(rows, **extra):
        df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOC_SCHEMA)
        for k, v in extra.items():
            df = df.withColumn(k, F.lit(v))
        return df

    return make
