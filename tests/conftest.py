import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from taxolink.session import get_session, release_scratch
    s = get_session("local[4]", shuffle_partitions=8, app_name="taxolink-tests",
                    checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    release_scratch(s)
