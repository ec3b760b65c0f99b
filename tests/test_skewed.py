"""The models on tables in which one key holds a third of the rows, with the
plan for large window groups."""

import pytest

from tallyloom.plans.registry import MODELS
from tallyloom.session import GROUP_ROWS_KEY
from tests.oracle import check, connect
from tests.skew import write_skewed

FAMILIES = ("jon_", "agg_", "win_", "cmp_", "qlt_", "rec_")


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = write_skewed("/root/testdata/sf0.001", tmp_path_factory.mktemp("skewed"))
    spark.conf.set(GROUP_ROWS_KEY, "300")
    yield folder, connect(folder)
    spark.conf.unset(GROUP_ROWS_KEY)


@pytest.mark.parametrize("name", [n for n in MODELS if n.startswith(FAMILIES)])
def test_model_on_skewed_tables(spark, skewed, name):
    folder, con = skewed
    assert check(spark, con, folder, MODELS[name]) is None
