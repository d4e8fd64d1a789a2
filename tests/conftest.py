import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kinespark.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # tables are tiny here: compiling a plan's code would take longer than running it (the queries' own run compiles it)
    interpreted = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    return local_session(4, partitions=4, memory="4g", **interpreted)


@pytest.fixture(scope="session")
def sf():
    return SF
