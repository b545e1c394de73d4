import duckdb
import pytest


@pytest.fixture(scope="session")
def sf():
    """Rows of a table of the smallest data."""
    class Tables:
        dir = "/root/testdata/sf0.001"

        def __call__(self, name, *cols):
            return duckdb.sql(f"SELECT {', '.join(cols)} FROM '{self.dir}/{name}.parquet'").fetchall()

    return Tables()
