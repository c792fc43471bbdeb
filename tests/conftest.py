import pytest

from larkspur.session import build


@pytest.fixture(scope="session")
def spark():
    session = build(cpus=4, memory="3g", app="larkspur-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session
