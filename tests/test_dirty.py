"""The models on tables with NULL keys and measures, orphans, new categories."""

import pytest

from tallyloom.plans.registry import MODELS
from tests.dirty import write_dirty
from tests.oracle import check, connect


@pytest.fixture(scope="module")
def dirty(tmp_path_factory):
    folder = write_dirty("/root/testdata/sf0.001", tmp_path_factory.mktemp("dirty"))
    return folder, connect(folder)


@pytest.mark.parametrize("name", [n for n in MODELS if not n.startswith(("src_", "snk_"))])
def test_model_on_dirty_tables(spark, dirty, name):
    folder, con = dirty
    assert check(spark, con, folder, MODELS[name]) is None
