"""Calls to remote models: which errors are tried again, what is paid for, and what replies must hold."""

import glob
import json
import logging
import pickle
from types import SimpleNamespace

import pytest

from docspark.sources import connectors


def error(name="Trouble", status=None, response=None):
    return type(name, (Exception,), {} if status is None else {"status_code": status})() if response is None else type(name, (Exception,), ({} if status is None else {"status_code": status}) | {"response": response})()


def response(status=None, **headers):
    return SimpleNamespace(status_code=status, headers={k.replace("_", "-"): v for k, v in headers.items()})


@pytest.mark.parametrize(("raised", "want"), [
    (error(status=429, response=response(retry_after="3.0")), (True, 3.0, "http_429")),
    (error(status=429, response=response(Retry_After=" 10 ")), (True, 10.0, "http_429")),
    (error(status=429, response=response(RETRY_AFTER="-3.5")), (True, 0.0, "http_429")),
    (error(status=429, response=response(retry_after="soon")), (True, None, "http_429")),
    (error(status=429, response=response(retry_after="nan")), (True, None, "http_429")),
    (error(status=429, response=object()), (True, None, "http_429")),
    (error(status=429), (True, None, "http_429")),
    (error(response=response(503)), (True, None, "http_503")),
    (error(response=response(503, retry_after="9")), (True, None, "http_503")),
    (error(response=response(404)), (False, None, "http_404")),
    (error(status="404"), (False, None, "Trouble")),
    *[(error(status=s), (s not in (400, 404), None, f"http_{s}")) for s in (408, 409, 500, 599, 400, 404)],
    *[(error(n), (True, None, n)) for n in ("RateLimitError", "APITimeoutError", "APIConnectionError", "InternalServerError")],
    (error("RateLimitError", 302), (True, None, "RateLimitError")),
    (error(), (False, None, "Trouble")),
])
def test_which_errors_are_tried_again(raised, want):
    assert connectors.retry_rule(raised) == want


def test_retries_wait_as_asked_and_end(caplog):
    def run(*outcomes, **options):
        slept, left = [], list(outcomes)

        def call():
            now = left.pop(0)
            if isinstance(now, Exception):
                raise now
            return now

        try:
            return connectors.with_retries(call, sleep=slept.append, **options), slept, len(left)
        except Exception as e:
            return e, slept, len(left)

    busy, down, bad = error(status=429, response=response(retry_after="2.5")), error(status=500), error(status=400)
    assert run("ok") == ("ok", [], 0)
    with caplog.at_level(logging.WARNING):
        assert run(busy, down, "ok", log=logging.getLogger("x"), label="embed") == ("ok", [2.5, 2.0], 0)
    assert "embed: http_429" in caplog.text and "embed: http_500" in caplog.text
    assert run(down, down, down, "late", max_retries=2, base_delay=0.5) == (down, [0.5, 1.0], 1)
    assert run(bad, "late") == (bad, [], 1) and run(error(status=429, response=response(retry_after="-1")), "ok") == ("ok", [0.0], 0)


def test_remote_models_own_their_client():
    made = []

    class Client:
        def __init__(self):
            item = lambda i, v: SimpleNamespace(index=i, embedding=v)
            self.embeddings = SimpleNamespace(create=lambda model, input: SimpleNamespace(data=[item(i, [float(len(t)), 1.0] if t else []) for i, t in reversed(list(enumerate(input)))]))
            self.responses = SimpleNamespace(create=lambda **asked: made.append(asked) or SimpleNamespace(output_text="", output=[SimpleNamespace(content=[SimpleNamespace(text='{"answer": "a", '), SimpleNamespace(text='"citation_ids": []}')])]))

    def connect(key, timeout):
        made.append((key, timeout))
        return Client()

    embedder = connectors.RemoteEmbedder("m", "k", 5.0, connect)
    assert embedder.embed([]) == [] and made == []  # nothing to ask, no client
    assert embedder.embed(["a", "bbb"]) == [[1.0, 1.0], [3.0, 1.0]] and embedder.embed(["c"]) and made == [("k", 5.0)]
    with pytest.raises(RuntimeError, match="no embedding"):
        embedder.embed(["a", ""])
    embedder.connect = None
    assert "_client" not in pickle.loads(pickle.dumps(embedder)).__dict__
    made.clear()
    reply = connectors.RemoteGenerator("m", "k", 5.0, connect).generate("why", "[C1] text")
    assert connectors.parse_answer(reply) == "a" and made[1]["text"]["format"]["schema"] == connectors.REPLY_SCHEMA and "[C1] text" in made[1]["input"][1]["content"]
    for key, said in ((" ", "key"), ("k", "not installed")):
        with pytest.raises(RuntimeError, match=said):
            connectors.RemoteGenerator("m", key).client
    for bad in ("no json", "[]", "{}"):
        with pytest.raises(RuntimeError):
            connectors.parse_answer(bad)


class Counted:
    """Notes each text it is asked for; fails while the folder holds a file named broken, for one text."""

    def __init__(self, folder):
        self.folder = folder

    def embed(self, texts):
        import os
        import uuid

        if os.path.exists(f"{self.folder}/broken") and "text 77" in texts:
            raise ValueError("lost")
        with open(f"{self.folder}/{uuid.uuid4().hex}.json", "w") as f:
            json.dump(texts, f)
        return [[float(len(t))] for t in texts]


def test_texts_are_paid_for_once(spark, tmp_path):
    """A run is lost in some wave; the next asks only for what has no reply yet, and the one after for nothing."""
    calls, ledger, folder = tmp_path / "calls", str(tmp_path / "ledger"), str(tmp_path / "calls")
    calls.mkdir()
    (calls / "broken").touch()
    rows = spark.createDataFrame([(i, f"text {i % 100}") for i in range(250)] + [(900, None)], "i int, text string").repartition(3)
    make = lambda: Counted(folder)
    embed = lambda: connectors.embed_once(rows, make, ledger, "m", batch_size=5, wave=20)
    asked = lambda: [t for f in glob.glob(f"{folder}/*.json") for t in json.load(open(f))]
    with pytest.raises(Exception, match="lost"):
        embed()
    first = asked()
    kept = spark.read.schema("digest binary").parquet(ledger).count()
    (calls / "broken").unlink()
    got = {(r["i"], r["embedding"][0]) for r in embed().collect()}
    assert got == {(i, float(len(f"text {i % 100}"))) for i in range(250)} | {(900, 0.0)}
    # texts in waves before the lost one were asked for once, those of the lost wave twice at most
    assert set(asked()) == {f"text {i}" for i in range(100)} | {""} and len(asked()) == 101 + len(first) - kept and 0 <= len(first) - kept < 40
    embed().count()
    assert len(asked()) == 101 + len(first) - kept
    assert connectors.embed_once(rows.limit(3), make, ledger, "other").count() == 3 and len(asked()) > 101 + len(first) - kept


class CountingEmbedder:
    def embed(self, texts):
        return [[float(len(texts)), float(sum(map(len, texts)))]] * len(texts)


def test_an_embedding_worker_gets_bounded_batches(spark):
    rows = spark.range(0, 8000, 1, 1).selectExpr("id", "repeat('word ', 2000) AS text")
    got = connectors.embed_texts(rows, CountingEmbedder, batch_size=10**6).select("embedding").collect()
    assert len(got) == 8000
    assert max(r[0][0] for r in got) <= 3000 and max(r[0][1] for r in got) <= 20e6
