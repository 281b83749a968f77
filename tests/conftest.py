import pytest

from lamina.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")), spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
