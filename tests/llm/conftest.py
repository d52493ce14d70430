import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

MEMORY = "id long, hash string, source_lang string, target_lang string, source_text string, previous_source_text string, translated_text string, status string, provider string"


@pytest.fixture(scope="session")
def memory(spark):
    """Builds a memory of ``(id, source, target)`` or longer rows; further fields by name."""

    def build(*rows, **more):
        full = [(i, None, more.get("source_lang", "de"), more.get("target_lang", "en"), s, None, t, more.get("status", "auto"), "deepl") for i, s, t in rows]
        # a clashing extra column, as tables may carry them
        return spark.createDataFrame(full, MEMORY).withColumns({"text": spark_lit("x"), "pair": spark_lit("y"), "bytes": spark_lit(1)})

    from pyspark.sql import functions as F

    spark_lit = F.lit
    return build
