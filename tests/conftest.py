import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from barquarry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = local_session(8, 4)
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    # The series here are tiny: compiling code for each plan would take most of the time.
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    return spark


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars of one symbol from (open, high, low, close[, volume]) rows, one per day."""

    def build(rows, symbol="A", start="2020-01-01"):
        first = dt.date.fromisoformat(start)
        data = [
            (symbol, first + dt.timedelta(days=i), *(None if x is None else float(x) for x in r[:4]),
             float(r[4]) if len(r) > 4 else 100.0)
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(
            data, "symbol string, date date, open double, high double, low double, close double, volume double"
        )

    return build
