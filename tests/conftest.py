import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from weftline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
