import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from runledger.session import ROCKSDB, local_session

    session = local_session("tests", memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples."""
    def collect(df, *columns):
        df = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
