import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}".rstrip(":")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from veracta.session import local_session

    session = local_session(4, partitions=4, memory="4g", **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """The value of a column over one row of named values."""
    from pyspark.sql import functions as F

    def run(make, **values):
        kinds = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
        df = spark.createDataFrame([tuple(values.values())], kinds)
        return df.select(make(*(F.col(k) for k in values)).alias("r")).first().r

    return run
