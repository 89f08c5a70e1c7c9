import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from evalframe.runtime import drop_scratch, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", "local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    drop_scratch(spark)
    spark.stop()
