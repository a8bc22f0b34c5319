import sys

import pytest
from paths import ROOT, SF0001

sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from replenish.session import get_session

    s = get_session(cpus="*", shuffle_partitions=8, app="replenish-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def inputs_small(spark):
    from replenish.sources.tables import load_inputs

    return load_inputs(spark, SF0001)
