import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rollscope.session import build_session, shared_dir
    s = build_session(master="local[4]", shuffle_partitions=4,
                      extra={"spark.ui.showConsoleProgress": "false"})
    shared_dir(s)  # sets a private checkpoint folder only when the session names none
    yield s
    s.stop()


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
