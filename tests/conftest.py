import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from marquee.session import local_session
    session = local_session("tests", cores=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SMALL).exists():
        pytest.skip("no test tables here")
    return SMALL


@pytest.fixture
def answers(spark):
    """Values of a column expression over a list of texts, in order."""
    from pyspark.sql import functions as F

    def run(expression, texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING")
        out = rows.select("i", expression.alias("out") if not callable(expression) else expression(F.col("text")).alias("out"))
        return [r["out"] for r in sorted(out.collect())]

    return run
