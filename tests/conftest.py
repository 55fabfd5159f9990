from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from needwell.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """apply(fn, values): results of a one-column function over a list of values."""

    def run(fn, values, dtype="string"):
        from pyspark.sql import functions as F

        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        width = len(rows[0]) - 1
        types = dtype if isinstance(dtype, list) else [dtype] * width
        schema = "i INT, " + ", ".join(f"c{k} {t}" for k, t in enumerate(types))
        df = spark.createDataFrame(rows, schema)
        out = df.select("i", fn(*[F.col(f"c{k}") for k in range(width)]).alias("out"))
        return [r.out for r in sorted(out.collect())]

    return run


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text)
