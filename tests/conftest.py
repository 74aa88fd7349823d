import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from inkweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("work")
    session = build_session("inkweave-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(work / "checkpoint"),
        "spark.sql.warehouse.dir": str(work / "warehouse"),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def check(spark):
    """Evaluate column expressions over literal rows and compare with the last column."""
    def run(schema, rows, expression):
        names = [part.split()[0] for part in schema.split(",")]
        got = spark.createDataFrame(rows, schema).select(*names, expression.alias("got")).collect()
        wrong = [(tuple(r)[:-2], r[names[-1]], r["got"]) for r in got if r["got"] != r[names[-1]]]
        assert not wrong, wrong
    return run
