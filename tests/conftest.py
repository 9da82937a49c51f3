import pytest

from tests.compare import TESTDATA, connect, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture
def panel(spark):
    """Frame of (store_id, sku_id, date, units_sold) from {(store, sku): values}, one value per day."""
    import datetime as dt

    def build(series, start=dt.date(2024, 1, 1)):
        rows = [
            (store, sku, start + dt.timedelta(days=i), None if v is None else float(v))
            for (store, sku), values in series.items()
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, "store_id string, sku_id string, date date, units_sold double")

    return build
