import json

import pytest

from recallforge.__main__ import main


def test_commands(spark, tmp_path, capsys):
    def call(*args, code=0):
        assert main(["--data", str(tmp_path / "db"), *args], spark) == code
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    call("init"), call("create-tenant", "t"), call("create-collection", "t", "c")
    call("remember", "t", "c", "m", "the listener port", "--meta", "env=prod", "--confidence", "0.7", "--type", "semantic")
    call("put-record", "t", "c", "systems", "pg", '{"engine": "postgresql"}')
    assert [r["id"] for r in call("recall", "t", "listener", "--mode", "text", "--meta", "env=prod")] == ["m"]
    assert [r["id"] for r in call("query", "t", "SELECT * FROM systems WHERE engine=postgresql")] == ["pg"]
    assert call("show-memory", "t", "c", "m")[0]["confidence"] == 0.7
    assert call("add-edge", "t", "e", "record", "pg", "memory", "m", "about")[0]["relation"] == "about"
    assert [r["node"] for r in call("traverse", "t", "--seed", "m")] == ["pg"]
    assert "[memory:m]" in call("build-context", "t", "listener")[0]["text"]
    assert len(call("audit", "t")) == 1 and call("inspect") == [{"tenant_id": "t", "collections": ["c"]}]
    call("delete-edge", "t", "e"), call("forget", "t", "c", "m")
    assert call("list-memories", "t") == [] and call("show-memory", "t", "c", "m", code=1) == []
    call("query-records", "t", "select * from systems", code=1)
    with pytest.raises(SystemExit):
        call("remember", "t", "c", "m", "x", "--meta", "novalue")


def test_quality_fixture(spark, tmp_path, capsys):
    memories = [{"id": "net", "text": "listener refused the connection, check port 1521"}, {"id": "vac", "text": "vacuum removes dead rows from tables"}, {"id": "svc", "text": "start the database service with the control tool"}]
    cases = [{"name": "dead", "query": "vacuum dead rows", "relevant_ids": ["vac"], "expected_first_ids": ["vac"], "answer_must_include": ["DEAD rows"]}, {"name": "port", "query": "conexão listener port", "relevant_ids": ["net"], "forbidden_first_ids": ["vac"]}]
    (tmp_path / "f.json").write_text(json.dumps({"version": 1, "memories": memories, "cases": cases, "thresholds": {"min_hit_at_1": 0.8, "min_hit_at_k": 1.0, "min_mrr": 0.9}}))
    assert main(["--data", str(tmp_path / "q"), "eval-quality", str(tmp_path / "f.json")], spark) == 0
    out = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert out["passed"] and out["mrr"] == 1.0
