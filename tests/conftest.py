import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skeinlog.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def as_lines(spark):
    """Session lines from ``{session: [text, ...]}``; positions are spread so that chunks stay tiny."""

    def make(sessions: dict[str, list[str]], width: int = 2):
        rows = [(s, i // width, i, line) for s, lines in sessions.items() for i, line in enumerate(lines)]
        return spark.createDataFrame(rows, "session_id string, chunk bigint, off bigint, line string")

    return make
