import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from paceline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Hundreds of tiny queries: compiling each plan would take most of the time.
    quick = {"spark.sql.codegen.wholeStage": "false", "spark.default.parallelism": "2"}
    session = local_session("8", shuffle_partitions=2, settings=quick)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
