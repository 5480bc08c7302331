import pytest

from playbill.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        # A zone other than UTC, so nothing may lean on the session's.
        "spark.sql.session.timeZone": "America/New_York",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Results of a column function over a list of values."""
    def run(fn, values, ddl="v string"):
        rows = [(i, v) for i, v in enumerate(values)]
        frame = spark.createDataFrame(rows, f"i int, {ddl}")
        from pyspark.sql import functions as F
        return [r.o for r in frame.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]

    return run
