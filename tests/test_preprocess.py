"""Models over HTTP, and the way from manuals to records through one."""

import io
import json
import logging
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from stepweave import cli, runs, settings
from stepweave.settings import BackendError, SettingsError
from stepweave.sources import clients
from stepweave.sources.readers import read_evidence_lines

TEXT = "# Pack leak diagnosis\n| Time step | Task |\n|---|---|\n| T1 | Inspect the coolant hose. Look for leak |\n| T2 | Replace the pump seal |\n"


@pytest.fixture
def server():
    """A server whose answers a test sets, by kind of request: a function of the request's body that gives a status and an answer."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            made.asked.append((self.path, self.headers.get("Authorization"), body))
            status, answer = made.answer(body)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(answer.encode() if isinstance(answer, str) else json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    made.asked, made.answer = [], None
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made
    made.shutdown()


def at(server, **more):
    return clients.Endpoint(f"127.0.0.1:{server.server_port}/", "m", wait=0, **more)


def test_addresses():
    assert clients.endpoint_url(" host:1/ ", "embeddings") == "http://host:1/v1/embeddings" and clients.endpoint_url("https://h/v3", "embeddings") == "https://h/v3/embeddings"
    assert clients.endpoint_url("https://h/v1/embeddings", "embeddings") == "https://h/v1/embeddings" and clients.endpoint_url("https://h/vision", "x") == "https://h/vision/v1/x"
    for bad in (("", "m"), ("http://h", "")):
        with pytest.raises(SettingsError):
            clients.Endpoint(*bad)


def test_chat_and_vectors(server):
    said = lambda text, why="stop": {"choices": [{"message": {"content": text}, "finish_reason": why}]}
    server.answer = lambda body: (503, "busy") if len(server.asked) < 3 else (200, said([{"text": "a"}, {"text": "b"}]))
    assert clients.chat(at(server, api_key="k"))("hello") == "ab"
    path, key, body = server.asked[-1]
    assert len(server.asked) == 3 and path == "/v1/chat/completions" and key == "Bearer k" and body["messages"] == [{"role": "user", "content": "hello"}]
    server.answer = lambda body: (200, said("half", "length"))
    with pytest.raises(BackendError, match="cut short"):
        clients.chat(at(server))("x")
    server.asked.clear()
    server.answer = lambda body: (404, "no such model")
    with pytest.raises(BackendError, match="404: no such model"):
        clients.chat(at(server))("x")
    assert len(server.asked) == 1
    server.answer = lambda body: (200, "no json")
    with pytest.raises(BackendError):
        clients.chat(at(server, tries=2))("x")
    server.answer = lambda body: (200, {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    assert clients.vectors(at(server), 1)(["a", "b"]) == [[1.0], [2.0]]
    for wrong in (lambda: clients.vectors(at(server))(["a"]), lambda: clients.vectors(at(server), 3)(["a", "b"])):
        with pytest.raises(BackendError):
            wrong()


def test_manuals_to_records(spark, server, tmp_path, capsys):
    """From the command line: manuals, a model over HTTP, records; a second run asks nothing and adds nothing."""
    (tmp_path / "in" / "battery").mkdir(parents=True)
    for name in ("BATOM_001", "BATOM_002"):
        (tmp_path / "in" / "battery" / f"{name}.md").write_text(TEXT.replace("pump", f"pump {name[-1]}") if name[-1] == "2" else TEXT)
    (tmp_path / "prompt.txt").write_text("Families: __RELATION_FAMILIES_JSON__\nTypes: __BACKBONE_CONCEPTS_JSON__\n__DOCUMENT_CONTENT__")
    payload = {"concepts": [{"label": "coolant hose", "semantic_type_hint": "Component", "node_worthy": True}, {"label": "leak", "semantic_type_hint": "Fault"}, None], "relations": [{"label": "inspects", "family": "task_dependency", "head": "T1", "tail": "coolant hose"}], "diagnostic_edges": [{"evidence_label": "coolant hose", "indicated_label": "leak", "mechanism": "communication"}], "state_transitions": []}
    server.answer = lambda body: (200, {"choices": [{"message": {"content": "```json\n" + json.dumps(payload) + "\n```"}}]})
    told = {"data_root": f"{tmp_path}/in", "output_path": f"{tmp_path}/out", "prompt_template_path": f"{tmp_path}/prompt.txt", "domain_ids": ["battery"], "answers_path": f"{tmp_path}/answers", "llm_host": f"127.0.0.1:{server.server_port}", "llm_model": "m", "relation_families": ["task_dependency", "communication"]}
    (tmp_path / "s.json").write_text(json.dumps(told))
    for _ in range(2):
        assert cli.main(["preprocess", "--config", f"{tmp_path}/s.json"]) == 0 and "2 records" in capsys.readouterr().out
    assert len(server.asked) == 2 and '"task_dependency",\n  "communication"' in server.asked[0][2]["messages"][0]["content"] and "Pack leak" in server.asked[0][2]["messages"][0]["content"]
    got = {r["evidence_id"]: r for r in read_evidence_lines(spark, f"{tmp_path}/out/domain_id=battery").collect()}
    assert sorted(got) == ["BATOM_001", "BATOM_002"]
    step = got["BATOM_001"]["step_records"][0]
    assert [m["label"] for m in step["concept_mentions"]][:1] == ["coolant hose"] and step["diagnostic_edges"][0]["indicated_label"] == "leak"
    assert cli.main(["preprocess", "--data-root", "x"]) == 1 and "needs --config" in capsys.readouterr().err


def test_settings_and_logging(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"data_root": "a", "output_path": "b", "prompt_template_path": "c", "llm": {"base_url": "h", "model": "m"}}))
    told = runs.load_preprocess_settings(f"{tmp_path}/s.json")
    assert told.domain_ids == ("battery", "cnc", "nev") and told.llm.timeout_sec == 120
    for extra, words in (({"odd": 1}, "no odd"), ({"role": "other"}, "role"), ({"llm": {"base_url": "h"}}, "model")):
        (tmp_path / "s.json").write_text(json.dumps({"data_root": "a", "output_path": "b", "prompt_template_path": "c", "llm": {"base_url": "h", "model": "m"}} | extra))
        with pytest.raises(SettingsError, match=words):
            runs.load_preprocess_settings(f"{tmp_path}/s.json")
    out = io.StringIO()
    for level in (logging.INFO, logging.WARNING):
        own = settings.configure_logging(level, out)
    own.info("quiet")
    own.warning("loud")
    assert out.getvalue().count("\n") == 1 and "stepweave - WARNING - loud" in out.getvalue()
    own.handlers = [h for h in own.handlers if getattr(h, "stream", None) is not out]
