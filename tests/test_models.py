"""Backends: batches, threads, waits, HTTP forms against a server of our own, a model file."""

import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from parcelflow.models import base, http, local, steps


def test_batches_reach_the_model_whole(spark):
    df = spark.createDataFrame([(i, [f"/{i}.jpg"]) for i in range(11)], "id int, paths array<string>").coalesce(1)

    def backend():
        return base.BatchBackend(lambda rs: [None if "/3.jpg" in i else base.ModelOutput(f"{len(rs)} {i[0]} {p}") for i, p in rs])

    got = {r["id"]: r for r in base.infer(df, backend, "p", batch=4).collect()}
    assert [got[i]["text"] and got[i]["text"].split()[0] for i in range(11)] == ["4"] * 3 + [None] + ["4"] * 4 + ["3"] * 3
    assert got[5]["text"] == "4 /5.jpg p" and got[3]["status"] == "failed" and got[3]["error"] is None
    bad = base.infer(df, lambda: base.BatchBackend(lambda rs: [None]), "p", batch=4).collect()
    assert {r["status"] for r in bad} == {"failed"} and all("answers to" in r["error"] for r in bad if r["id"] < 8)


def test_threads_run_at_once_and_keep_order():
    meet = threading.Barrier(4, timeout=10)

    class Slow(base.Backend):
        def run(self, images, prompt, **options):
            meet.wait()
            if prompt == "2":
                raise ValueError("two")
            return base.ModelOutput(prompt)

    got = Slow().run_batch([([], str(k)) for k in range(4)], threads=4)
    assert [r and r.text for r, _ in got] == ["0", "1", None, "3"] and got[2][1] == "ValueError: two"


def test_failures_in_a_row_cool_down():
    waits, answers = [], iter([None, None, "x", "y", None, "z"])
    b = base.Cooling(base.StubBackend(lambda i, p: next(answers)), 100.0, waits.append)
    got = [r and r.text for r, _ in b.run_batch([([], "p")] * 6)]
    assert got == [None, None, "x", "y", None, "z"]
    assert [round(w, -1) for w in waits] == [100, 200, 100]


@pytest.fixture
def server():
    seen, answers = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, body = answers.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen, answers
    s.shutdown()


def test_http_forms(server, tmp_path, monkeypatch):
    url, seen, answers = server
    (tmp_path / "a.png").write_bytes(b"png")
    (tmp_path / "key").write_text("k-file\n")
    monkeypatch.setenv("OWN_KEY", "k-env")
    image, data = str(tmp_path / "a.png"), base64.b64encode(b"png").decode()
    answers += [(503, {}), (200, {"choices": [{"finish_reason": "stop", "message": {"content": "one"}}]}), (200, {"choices": [{"finish_reason": "content_filter", "message": {"content": "no"}}]})]
    chat = http.HttpBackend(url, "m", "chat", "OWN_KEY", json_mode=True, wait=0.01)
    assert chat.run([image, "http://x/y.jpg"], "look").text == "one" and chat.run([], "look") is None
    head, body = seen[1]
    assert head["Authorization"] == "Bearer k-env" and body["response_format"] == {"type": "json_object"}
    assert [p.get("image_url", {}).get("url") for p in body["messages"][0]["content"]] == [None, f"data:image/png;base64,{data}", "http://x/y.jpg"]
    answers += [(200, {"content": [{"type": "text", "text": "two"}]}), (400, {"error": "bad"})]
    blocks = http.HttpBackend(url, "m", "blocks", str(tmp_path / "key"), json_mode=True)
    assert blocks.run([image], "look").text == "two"
    assert seen[-1][0]["X-Api-Key"] == "k-file" and seen[-1][1]["messages"][0]["content"][0]["source"] == {"type": "base64", "media_type": "image/png", "data": data} and seen[-1][1]["system"] == http.JSON_HINT
    assert "status 400" in blocks.run_batch([([], "x")])[0][1]
    answers += [(200, {"candidates": [{"content": {"parts": [{"text": "th"}, {"text": "ree"}]}}]}), (200, {"candidates": [{"finishReason": "SAFETY"}]})]
    parts = http.HttpBackend(url, "m", "parts", "plain")
    assert parts.run([image], "look").text == "three" and parts.run([image], "look") is None
    assert seen[-1][1]["contents"][0]["parts"][1] == {"inline_data": {"mime_type": "image/png", "data": data}}
    assert "at least one image" in parts.run_batch([([], "x")])[0][1]


def _field(n: int, v) -> bytes:
    def varint(x: int) -> bytes:
        out = b""
        while True:
            out += bytes([x & 127 | (128 if x > 127 else 0)])
            x >>= 7
            if not x:
                return out

    return varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v


def _model(path) -> str:
    """A model file whose output is its input of n x 2 numbers and itself, added."""
    shape = b"".join(_field(1, d) for d in (_field(2, b"n"), _field(1, 2)))
    value = lambda name: _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))
    node = _field(1, b"x") + _field(1, b"x") + _field(2, b"y") + _field(4, b"Add")
    graph = _field(1, node) + _field(2, b"g") + _field(11, value(b"x")) + _field(12, value(b"y"))
    path.write_bytes(_field(1, 8) + _field(7, graph) + _field(8, _field(1, b"") + _field(2, 13)))
    return str(path)


def test_a_model_file_takes_batches(spark, tmp_path):
    path = _model(tmp_path / "m.onnx")

    def before(requests):
        at = [k for k, (i, _) in enumerate(requests) if i]
        return at, np.array([[float(requests[k][0][0]), 1.0] for k in at], np.float32)

    df = spark.createDataFrame([(1, ["3"]), (2, []), (3, ["5"])], "id int, paths array<string>").coalesce(1)
    got = base.infer(df, lambda: local.OnnxBackend(path, before, lambda o: base.ModelOutput(str(o[0].tolist()))), "p").collect()
    assert {r["id"]: r["text"] for r in got} == {1: "[6.0, 2.0]", 2: None, 3: "[10.0, 2.0]"}


def test_masks_go_to_their_images(spark):
    a = spark.createDataFrame([("a",), ("b",)], "id string")
    i = spark.createDataFrame([("a", "i1", "/1"), ("b", "i2", "/bad"), ("c", "i3", "/3")], "asset_id string, id string, path string").selectExpr("*", "map('k', cast(1 as variant)) as props")

    class Segments(base.Backend):
        name = "seg"

        def run(self, images, prompt, **options):
            return None if images == ["/bad"] else base.ModelOutput(boxes=[[0, 0, 2, 3]], masks=[[[0, 0], [2, 0], [2, 3]]])

    got = {r["id"]: json.loads(r["j"]) for r in steps.mask_rows(a, i, Segments, ["roof"]).selectExpr("id", "to_json(props) as j").collect()}
    assert got == {"i1": {"k": 1, "segment_boxes": [[0, 0, 2, 3]], "segment_masks": [[[0, 0], [2, 0], [2, 3]]], "ai_model_used": "seg"}, "i2": {"k": 1}, "i3": {"k": 1}}
