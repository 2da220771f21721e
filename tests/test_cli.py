import json
import os

import pytest

from folio import cli
from folio.errors import FolioError
from folio.plans import runs


def test_a_book_from_init_to_bundle(spark, tmp_path):
    source, run = tmp_path / "book.pdf", str(tmp_path / "run")
    source.write_bytes(b"%PDF")
    assert cli.main(["init", "--run", run, "--source", str(source)]) == 0
    assert cli.main(["init", "--run", run, "--source", str(source)]) == 13
    assert cli.main(["init", "--run", str(tmp_path / "other"), "--source", "nowhere"]) == 14 and not (tmp_path / "other").exists()
    responses = [("b", k, json.dumps({"page_type": "body", "blocks": [{"kind": "text", "role": "paragraph", "segments": [{"kind": "text", "value": f"page {k}"}]}]})) for k in range(3)]
    spark.createDataFrame(responses, "book_id string, page_index int, response string").write.parquet(str(tmp_path / "responses"))
    assert cli.main(["process", "--run", run, "--responses", str(tmp_path / "responses")]) == 0
    assert cli.main(["render-markdown", "--run", run, "--bundles", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out/b/book.md").read_text() == "page 0\n\npage 1\n\npage 2\n"
    with pytest.raises(SystemExit) as e:
        cli.main(["process", "--run", run, "--responses", "x", "--through-page", "1", "--max-pages", "2"])
    assert e.value.code == 2


def test_guards(tmp_path):
    source, run = tmp_path / "book.pdf", str(tmp_path / "run")
    source.write_bytes(b"%PDF")
    runs.start(run, str(source), runs.Options(), prompt="p")
    runs.guard(run, prompt="p")
    with pytest.raises(FolioError, match="config-drift"):
        runs.guard(run, prompt="q")
    source.write_bytes(b"%PDF2")
    with pytest.raises(FolioError, match="source-hash-mismatch"):
        runs.guard(run, prompt="p")
    with runs.locked(run), pytest.raises(FolioError, match="run-locked"), runs.locked(run):
        pass
    os.symlink(run, tmp_path / "link")
    with pytest.raises(FolioError, match="symbolic link"), runs.locked(str(tmp_path / "link")):
        pass


def test_moved_files_and_environments(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_bytes(b"model")
    b.write_bytes(b"model")
    assert runs.relocate(runs.fingerprint(str(a)), str(b))["path"] == str(b)
    b.write_bytes(b"other")
    with pytest.raises(FolioError):
        runs.relocate(runs.fingerprint(str(a)), str(b))
    path = str(tmp_path / "env.json")
    runs.write_once(path, {"x": 1})
    runs.write_once(path, {"x": 1})
    with pytest.raises(FolioError, match="inference-environment-drift"):
        runs.write_once(path, {"x": 2})
