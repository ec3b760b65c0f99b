import pytest
from pyspark.sql import SparkSession

from tallyloom.session import GROUP_ROWS_KEY, configure


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


@pytest.fixture
def split_groups(spark):
    """Force the plan for large groups: no task may sort more than 5 rows."""
    spark.conf.set(GROUP_ROWS_KEY, "5")
    yield spark
    spark.conf.unset(GROUP_ROWS_KEY)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
