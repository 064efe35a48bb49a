import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from assay.plans.chat import Chat, described, from_environment, provider
from assay.plans.generate import generate_in_two
from assay.plans.model import PlanError

GROUPS = {"groups": [{"group_id": "g1", "execution_order": 1, "datasets": ["people"], "checks": ["C"]}]}
STEPS = {"steps": [{"type": "NORMALIZE", "dataset": "people", "output_alias": "n"}, {"type": "COMPLETENESS", "input": "n", "check_field": "status", "output_alias": "c", "check_id": "C"}]}


@pytest.fixture
def server():
    """An endpoint that gives the answers in its list, in turn: (status, content of the message)."""
    answers, seen = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, content = answers.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": content}}]}).encode())

        def log_message(self, *args):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}/v1/chat", answers, seen
    made.shutdown()


def test_groups_then_steps(server):
    url, answers, seen = server
    answers += [(500, ""), (200, json.dumps(GROUPS)), (200, "no json"), (200, json.dumps(STEPS))]
    chat = Chat(url, "some-model", "key", wait=0)
    (group,) = generate_in_two(chat, "status must be there", {"people": {"status": "string"}, "other": {"x": "integer"}}, {"people": [{"status": "A"}], "other": []}, wait=0)
    assert group.group_id == "g1" and [s.kind for s in group.plan.steps] == ["NORMALIZE", "COMPLETENESS"] and group.checks == ("C",)
    headers, body = seen[-1]
    assert headers["Authorization"] == "Bearer key" and body["model"] == "some-model" and body["temperature"] == 0
    asked = json.loads(body["messages"][1]["content"])
    assert asked["wanted"] == "steps" and set(asked["schemas"]) == {"people"} and asked["errors"] and set(asked["samples"]) == {"people"}
    assert json.loads(seen[1][1]["messages"][1]["content"])["wanted"] == "groups"


def test_failures(server, monkeypatch):
    url, answers, seen = server
    answers += [(503, "")] * 3 + [(401, "")] + [(200, "[]")]
    chat = Chat(url, "m", wait=0)
    for said in ("no answer", "no answer", "no JSON object"):
        with pytest.raises(PlanError, match=said):
            chat({})
    assert len(seen) == 5 and "Authorization" not in seen[0][0]
    with pytest.raises(PlanError, match="no answer"):
        Chat("http://127.0.0.1:9/none", "m", retries=1)({})
    with pytest.raises(PlanError, match="ASSAY_CHAT_MODEL"):
        from_environment({"ASSAY_CHAT_URL": url})
    answers.append((200, json.dumps(GROUPS)))
    monkeypatch.setenv("ASSAY_CHAT_URL", url)
    monkeypatch.setenv("ASSAY_CHAT_MODEL", "m")
    assert provider({"wanted": "groups"}) == GROUPS and provider.two_stages


def test_steps_are_described():
    assert all(kind in described() for kind in ("NORMALIZE (dataset", "RECONCILIATION", "key_columns", "flag_field"))
