import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", "")
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ['PYTHONPATH']}"


@pytest.fixture(scope="session")
def spark():
    from khata.session import session

    s = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "2", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """Sorted rows of a DataFrame as tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
