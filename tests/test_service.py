import json
import threading
import urllib.error
import urllib.request

import pytest

from tidemark.plans.engine import Engine
from tidemark.plans.service import Service, serve
from tidemark.plans.snapshots import run_tests
from tidemark.plans.table_type import TableType

SCRIPT = """
X := SELECT id, v FROM T ORDER BY id DESC;
/*+ cache(1 hour) */ F(least BIGINT NOT NULL) := SELECT id FROM T WHERE id >= :least ORDER BY id;
/*+ no_query */ Quiet := SELECT id FROM T;
/*+ test */ XTest := SELECT id, v FROM X WHERE id < 3;
/*+ test(no_rows) */ None_ := SELECT id FROM T WHERE id > 100;
"""


@pytest.fixture
def engine(spark):
    e = Engine(spark, goal="test")
    e.register("T", spark.createDataFrame([(i, f"v{i}") for i in range(5)], "id long, v string"), TableType.STATE, ["id"])
    return e.run(SCRIPT)


def test_snapshots(engine, tmp_path, spark):
    folder = str(tmp_path / "s")
    assert run_tests(engine, folder) == {"XTest": "created", "None_": "passed"}
    assert run_tests(engine, folder) == {"XTest": "passed", "None_": "passed"}
    other = Engine(spark, goal="test")
    other.register("T", spark.createDataFrame([(1, "changed"), (200, "z")], "id long, v string"), TableType.STATE, ["id"])
    assert set(run_tests(other.run(SCRIPT), folder).values()) & {"passed", "created"} == set()


def test_requests(engine):
    s = Service(engine)
    assert s.request("X", limit=2) == [{"id": 4, "v": "v4"}, {"id": 3, "v": "v3"}]
    first = s.request("F", {"least": 3})
    assert first == [{"id": 3}, {"id": 4}] and s.request("F", {"least": 3}) is first
    for bad in (lambda: s.request("Quiet"), lambda: s.request("Nothing"), lambda: s.request("X", limit=0)):
        with pytest.raises(ValueError):
            bad()


def test_http(engine):
    server = serve(Service(engine))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda p: json.load(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}", timeout=60))
    try:
        assert get("/F?least=4") == [{"id": 4}] and "X" in get("/")
        assert get("/X?limit=1&offset=1") == [{"id": 3, "v": "v3"}]
        with pytest.raises(urllib.error.HTTPError):
            get("/Quiet")
    finally:
        server.shutdown()
