import os
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TZ", "UTC")

import pytest  # noqa: E402

from strandframe.session import local_session, ship_modules  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    ship_modules(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no test tables")
    return d
