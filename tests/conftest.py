import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgersieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """A table of text columns from a header and lists of values."""

    def build(columns, *values):
        names = columns.split()
        return spark.createDataFrame([tuple(v) for v in values], ", ".join(f"`{n.replace('~', ' ')}` string" for n in names))

    return build


def severities(findings, check=None):
    """Sorted ``check, severity`` pairs."""
    got = [(r.check_id, r.severity) for r in findings.select("check_id", "severity").collect()]
    return sorted(s for c, s in got if c == check) if check else sorted(got)
