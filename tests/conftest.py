import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from reportlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    session = local_session(
        "4",
        "reportlake-tests",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.sql.warehouse.dir": str(home / "warehouse"),
            "spark.driver.memory": "4g",
        },
    )
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(home / "checkpoints"))
    yield session
    session.stop()


@pytest.fixture
def database(spark):
    name = "testing"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


@pytest.fixture
def plan_of():
    """Text of the physical plan of a DataFrame."""

    def text(df, brief=True):
        explain = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
        return explain(df._jdf.queryExecution(), "simple" if brief else "formatted")

    return text
