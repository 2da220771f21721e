"""Commit log, publish transaction, model client, context: what a run does on files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folio import cli
from folio.errors import FolioError
from folio.plans import client, flows
from folio.plans.log import Log
from folio.plans.outputs import STEPS, Output
from folio.operators.store import RECOVERY
from folio.sources import wire


def _response(text, **more):
    return json.dumps({"page_type": "body", "blocks": [{"kind": "text", "role": "paragraph", "segments": [{"kind": "text", "value": text}]} | more]})


def _started(tmp_path):
    source, run = tmp_path / "book.pdf", str(tmp_path / "run")
    source.write_bytes(b"%PDF")
    assert cli.main(["init", "--run", run, "--source", str(source)]) == 0
    return run


def _give(spark, path, rows):
    spark.createDataFrame(rows, "book_id string, page_index int, response string").write.mode("overwrite").parquet(path)
    return path


def test_process_goes_on_from_the_head_and_stops_where_a_rule_fails(spark, tmp_path):
    run, given = _started(tmp_path), str(tmp_path / "responses")
    note = [{"kind": "footnote", "label": "1", "segments": []}]
    bad = json.dumps({"page_type": "body", "blocks": note})
    _give(spark, given, [("a", k, _response(f"a{k}")) for k in range(3)] + [("b", 0, _response("b0")), ("b", 1, bad), ("b", 2, _response("b2")), ("c", 0, _response("c0")), ("c", 1, "{"), ("d", 1, _response("gap"))])
    assert cli.main(["process", "--run", run, "--responses", given]) == 11
    log = Log(spark, run)
    assert sorted((r.book_id, r.page_index) for r in log.pages().collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0)]
    stops = spark.read.parquet(f"{run}/failures/failure-0001").collect()
    assert sorted((r.book_id, r.page_index, r.code) for r in stops) == [("b", 1, "orphan-footnote"), ("c", 1, "invalid-json")]
    assert json.load(open(f"{run}/failures/latest.json")) == {"failure": "failure-0001"}
    _give(spark, given, [("a", 0, _response("other")), ("b", 1, _response("b1")), ("c", 1, _response("c1")), ("d", 0, _response("d0"))])
    assert cli.main(["process", "--run", run, "--responses", given]) == 0
    pages = {(r.book_id, r.page_index): r.blocks[0].content[0].value for r in log.pages().collect()}
    assert pages["a", 0] == "a0" and pages["b", 1] == "b1" and pages["c", 1] == "c1" and pages["d", 0] == "d0" and len(pages) == 8
    assert log.head()["committed_page_count"] == 8 and log.head()["batches"] == 2
    with open(tmp_path / "book.pdf", "ab") as file:
        file.write(b"x")
    assert cli.main(["process", "--run", run, "--responses", given]) == 13


def test_pages_by_number_and_a_crash_before_the_head(spark, tmp_path):
    run, given = _started(tmp_path), str(tmp_path / "responses")
    _give(spark, given, [("a", k, _response(f"a{k}")) for k in range(5)])
    assert cli.main(["process", "--run", run, "--responses", given, "--max-pages", "2"]) == 0
    assert cli.main(["process", "--run", run, "--responses", given, "--max-pages", "2"]) == 0
    log = Log(spark, run)
    assert log.head()["committed_page_count"] == 4
    log.pages().write.parquet(f"{run}/pages/batch-0003")  # as if the run had died before the head was written
    assert log.pages().count() == 4
    assert cli.main(["process", "--run", run, "--responses", given, "--through-page", "5"]) == 0
    assert log.pages().count() == 5 and any(os.path.isdir(f"{run}/recovery/{x}/batch-0003") for x in os.listdir(f"{run}/recovery"))
    os.rename(f"{run}/pages/batch-0001", f"{run}/pages/lost")
    with pytest.raises(FolioError, match="invalid-run-layout"):
        log.pages()


class Crash(Exception):
    pass


def _build(text):
    def build(folder):
        import hashlib

        with open(f"{folder}/book.md", "w") as file:
            file.write(text)
        with open(f"{folder}/manifest.json", "w") as file:
            json.dump({"command": "markdown", "files": [{"path": "book.md", "sha256": hashlib.sha256(text.encode()).hexdigest(), "size_bytes": len(text)}]}, file)

    return build


def _steps(folder, first):
    seen = []
    out = Output(folder, pause=seen.append)
    if first:
        Output(folder).publish(_build("old"))
    out.publish(_build("new"))
    return seen


@pytest.mark.parametrize("first", [True, False])
def test_a_crash_at_any_step_leaves_a_whole_book(tmp_path, first):
    count = len(_steps(str(tmp_path / "probe/out"), first))
    assert count >= 6
    for stop in range(count):
        folder, left = str(tmp_path / f"{stop}/out"), [stop]

        def pause(step, left=left):
            if left[0] == 0:
                raise Crash(step)
            left[0] -= 1

        if first:
            Output(folder).publish(_build("old"))
        with pytest.raises(Crash):
            Output(folder, pause=pause).publish(_build("new"))
        again = Output(folder)
        again.recover()
        if os.path.isdir(folder):
            assert again.valid(folder) and open(f"{folder}/book.md").read() in ("old", "new")
        assert os.path.isdir(folder) or not first
        again.publish(_build("newest"))
        assert open(f"{folder}/book.md").read() == "newest"
        assert {x for x in os.listdir(tmp_path / str(stop))} <= {"out", "quarantine"}


def test_every_action_of_the_table_can_be_done():
    assert {act for *_, choices in RECOVERY for _, act in choices} <= set(STEPS)


@pytest.mark.parametrize("marker", ["{", "[]", '{"version":2}', '{"version":1,"command":"epub","phase":"building","candidate":"out.candidate.0123456789abcdef"}', '{"version":1,"command":"markdown","phase":"building","candidate":"../x"}'])
def test_markers_that_make_no_sense_are_set_aside(tmp_path, marker):
    out = Output(str(tmp_path / "out"))
    out.publish(_build("old"))
    (tmp_path / "out.transaction.json").write_text(marker)
    assert out.recover() is None and out.valid(out.folder) and len(os.listdir(tmp_path / "quarantine")) == 1


def test_recovery_without_a_marker(tmp_path):
    def made(name, text, broken=False):
        os.makedirs(tmp_path / name)
        _build(text)(str(tmp_path / name))
        if broken:
            (tmp_path / name / "book.md").write_text("cut")

    out = Output(str(tmp_path / "out"))
    made("out", "bad", broken=True)
    made("out.previous", "good")
    made("out.candidate.0123456789abcdef", "stray")
    assert out.recover() == "quarantine out.candidate.0123456789abcdef,quarantine-destination,restore-previous"
    assert open(f"{out.folder}/book.md").read() == "good"
    made("out.previous", "stale")
    assert out.recover() == "quarantine-previous" and out.recover() is None
    (tmp_path / "out/extra.txt").write_text("x")
    assert not out.valid(out.folder)


def test_a_candidate_that_is_not_what_it_says_is_not_published(tmp_path):
    out = Output(str(tmp_path / "out"))
    out.publish(_build("old"))

    def lies(folder):
        _build("new")(folder)
        with open(f"{folder}/book.md", "w") as file:
            file.write("other")

    with pytest.raises(FolioError, match="differs"):
        out.publish(lies)
    assert open(f"{out.folder}/book.md").read() == "old" and out.recover() is None


def _body(content='{"a": 1}', **more):
    return json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": content} | more}]}).encode()


def _ask(answers, **options):
    waits, left = [], list(answers)

    def call(request):
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    return client.ask(call, {}, sleep=waits.append, **options), waits


def test_calls_are_repeated_where_that_may_help():
    answer, waits = _ask([(503, {"Retry-After": "7"}, b""), (200, {}, _body())])
    assert answer.content == {"a": 1} and waits == [7.0] and [a.error for a in answer.attempts] == ["http-retryable", None] and answer.attempts[1].body is None
    answer, waits = _ask([client.CallFailed("transport-timeout"), client.CallFailed("transport-error"), (200, {}, _body())], max_attempts=3)
    assert answer.error is None and waits == [1.0, 2.0]
    answer, waits = _ask([(500, {}, b"x"), (500, {}, b"y"), (200, {}, _body())], max_attempts=3)
    assert answer.error == "http-server-error" and len(answer.attempts) == 2 and answer.attempts[0].body == b"x"
    answer, waits = _ask([(400, {}, b"")])
    assert answer.error == "http-client-error" and waits == []
    answer, waits = _ask([(503, {"retry-after": "900"}, b""), (503, {}, b"")])
    assert answer.error == "http-retryable" and waits == [60.0]


@pytest.mark.parametrize(
    "body,code",
    [(b"{", "invalid-http-response"), (b"{}", "invalid-completion-envelope"), (b'{"choices": []}', "empty-response"), (_body(" "), "empty-response"), (_body("[1]"), "invalid-json"), (_body("{"), "invalid-json"), (_body(reasoning_content="so"), "unexpected-reasoning-content"), (json.dumps({"choices": [{"finish_reason": "length", "message": {"content": "{"}}]}).encode(), "output-token-limit")],
)
def test_completions_that_are_not_one_object(body, code):
    assert client.read_completion(body) == (None, code)
    assert _ask([(200, {}, body)])[0].error == code


def test_times_and_addresses():
    assert client.retry_after("2.5") == 2.5 and client.retry_after(None) is None and client.retry_after("soon") is None
    assert client.retry_after("Wed, 21 Oct 2015 07:28:00 GMT", now=1445412400.0) == 80.0
    assert client.retry_after("Wed, 21 Oct 2015 07:28:00 GMT") == 0.0
    assert client.url("http://x:1//", "/v1") == "http://x:1/v1"
    assert len(client.utc_now()) == 20 and client.utc_now().endswith("Z")


def test_books_are_read_page_by_page_with_what_is_known(spark):
    seen = []

    @flows.register("telling")
    def telling(pages):
        return pages.apply(lambda r: json.dumps({"page_type": "chapter_opening", "opening": {"kind": "chapter", "title": f"{r['content'].decode()}", "level": 1}, "printed_page_label": json.loads(r["context"])["current_section_title"]}), axis=1)

    raw = spark.createDataFrame([(b, k, f"{b}{k}".encode()) for b in "ab" for k in range(3 if b == "a" else 2)], "book_id string, page_index int, content binary")
    from folio.schemas import PAGES

    committed = spark.createDataFrame([], PAGES)
    for _ in range(3):
        due = flows.with_context(committed, raw)
        new = wire.to_domain(wire.parsed(flows.interpret(due, "telling"), "response"), "book_id", "page_index").drop("warnings")
        rows = new.collect()
        seen.append(sorted((r.book_id, r.page_index, r.printed_page_label) for r in rows))
        committed = committed.unionByName(spark.createDataFrame(rows, committed.schema))
    assert seen == [[("a", 0, None), ("b", 0, None)], [("a", 1, "a0"), ("b", 1, "b0")], [("a", 2, "a1")]]
    assert committed.agg(F.count("*")).first()[0] == 5
