import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from estatelens.session import build_session
    s = build_session(master="local[4]", app="estatelens-tests", shuffle_partitions=8,
                      extra={"spark.ui.showConsoleProgress": "false",
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="estatelens-wh-")})
    yield s
    s.stop()
