import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_cases import ROWS, frame  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
