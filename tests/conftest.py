import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from vecflow.session import get_spark
    from vecflow.sources import vec3

    s = get_spark("local[*]", shuffle_partitions=8, app="vecflow-tests")
    vec3.register(s)
    yield s


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)
