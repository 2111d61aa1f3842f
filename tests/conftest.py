import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in [os.environ.get("PYTHONPATH")] if p]])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        connection.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return connection


def rows_of(frame) -> list[tuple]:
    """Rows as sorted tuples of columns in order of name, floats to six places."""
    columns = sorted(frame.columns)
    pdf = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in pdf.itertuples(index=False)), key=repr)
