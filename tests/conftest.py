import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]
from market_helpers import walk  # noqa: E402

from tidebars.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture(scope="session")
def walks(spark):
    """Three symbols, 700, 300 and 31 bars."""
    pdf = pd.concat([walk(700, 1, symbol="X"), walk(300, 2, symbol="Y"), walk(31, 3, symbol="Z")])
    return spark.createDataFrame(pdf).repartition(5).cache()
