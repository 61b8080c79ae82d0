from __future__ import annotations

import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """Writes rows as the parquet tables of a data folder."""
    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write
