import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import get_spark

    session = get_spark("4", partitions=4, **{"spark.driver.memory": "4g"})
    yield session
    session.stop()
