import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in sorted(Path(DATA).iterdir()):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return v


def same(spark_df, rel) -> None:
    """The rows and columns of a Spark result and a DuckDB relation are equal, whatever their order."""
    cols = sorted(spark_df.columns)
    assert cols == sorted(rel.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in spark_df.collect()), key=repr)
    want = sorted((tuple(_plain(v) for v in r) for r in rel.select(*(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert got == want


@pytest.fixture(scope="session")
def same_rows():
    return same
