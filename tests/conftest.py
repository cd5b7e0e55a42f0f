import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from weftline.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_spark("local[4]", partitions=4, spark__driver__memory="4g")


@pytest.fixture(scope="session")
def small():
    return os.environ.get("WEFTLINE_TEST_DIR", "/root/testdata/sf0.001")
