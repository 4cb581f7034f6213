from __future__ import annotations

import pytest

from braidwork.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    where = tmp_path_factory.mktemp("spark")
    session = local_session(
        "4",
        4,
        **{
            "spark.sql.warehouse.dir": str(where / "warehouse"),
            "spark.checkpoint.dir": str(where / "shared"),
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
