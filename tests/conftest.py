import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cellscore.session import build_session

    s = build_session("tests", master="local[8]", **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"})
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
    return s
