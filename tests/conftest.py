import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from inkgrid.runtime import build_session

    s = build_session("local[4]", shuffle_partitions=4, memory="3g", **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("wh")), "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("ckpt"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
