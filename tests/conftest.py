import pytest

from tamiz.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
