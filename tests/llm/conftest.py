import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import __spark_entry__
    from taxolink.session import get_session, release_scratch
    s = get_session("local[4]", shuffle_partitions=4, app_name="taxolink-tests",
                    checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")))
    __spark_entry__._prepare(s)
    yield s
    release_scratch(s)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
