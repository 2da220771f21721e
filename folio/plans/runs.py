"""Runs on the driver: a folder with a record, a lock, drift guards, and the external EPUB step."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import shutil
import subprocess
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from folio.errors import FolioError
from folio.sources.files import RUN_VERSION, Options, run_record


def write_atomic(path: str, content: bytes) -> None:
    part = f"{path}.part"
    with open(part, "wb") as out:
        out.write(content)
        out.flush()
        os.fsync(out.fileno())
    os.replace(part, path)


def fingerprint(path: str, chunk: int = 1 << 20) -> dict[str, Any]:
    """Size, time and hash of a file, read in chunks."""
    digest, facts = hashlib.sha256(), os.stat(path)
    with open(path, "rb") as file:
        while piece := file.read(chunk):
            digest.update(piece)
    return {"path": os.path.abspath(path), "size_bytes": facts.st_size, "mtime_ns": facts.st_mtime_ns, "sha256": digest.hexdigest()}


def no_symlinks(path: str) -> None:
    """Every part of a path is itself, not a link to elsewhere."""
    at = os.sep if os.path.isabs(path) else "."
    for part in path.split(os.sep):
        at = os.path.join(at, part)
        if os.path.islink(at):
            raise FolioError("invalid-run-layout", f"{at} is a symbolic link")


@contextmanager
def locked(run: str) -> Iterator[None]:
    """Exclusive use of a run; a second process is refused at once."""
    no_symlinks(run)
    with open(os.path.join(run, ".lock"), "a") as file:
        try:
            fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise FolioError("run-locked", f"{run} is in use") from e
        yield


def start(run: str, source: str, options: Options, prompt: str = "", schema: str = "") -> dict[str, Any]:
    """A new run; everything is checked before anything is written."""
    if not os.path.isfile(source):
        raise FolioError("invalid-source-pdf", f"{source} is no file")
    if os.path.exists(os.path.join(run, "run.json")):
        raise FolioError("invalid-run-layout", f"{run} has a run already")
    record = {
        "run_format_version": RUN_VERSION, "source": fingerprint(source), "options": vars(options),
        "prompt_sha256": hashlib.sha256(prompt.encode()).hexdigest(), "schema_sha256": hashlib.sha256(schema.encode()).hexdigest(),
    }
    os.makedirs(run, exist_ok=True)
    write_atomic(os.path.join(run, "run.json"), json.dumps(record, sort_keys=True, ensure_ascii=False).encode())
    write_atomic(os.path.join(run, "head.json"), b'{"committed_page_count":0,"head_format_version":1}')
    return record


def guard(run: str, prompt: str = "", schema: str = "") -> dict[str, Any]:
    """The record of a run that nothing drifted from."""
    record = run_record(os.path.join(run, "run.json"))
    for name, text, code in (("prompt_sha256", prompt, "config-drift"), ("schema_sha256", schema, "schema-drift")):
        if record[name] != hashlib.sha256(text.encode()).hexdigest():
            raise FolioError(code, f"{name} changed")
    now = fingerprint(record["source"]["path"]) if os.path.isfile(record["source"]["path"]) else {}
    if any(now.get(k) != record["source"][k] for k in ("size_bytes", "sha256")):
        raise FolioError("source-hash-mismatch", "the source changed")
    return record


def write_once(path: str, value: dict[str, Any]) -> None:
    """An environment's record; a different one later is drift."""
    content = json.dumps(value, sort_keys=True, ensure_ascii=False).encode()
    if os.path.exists(path):
        with open(path, "rb") as file:
            if file.read() != content:
                raise FolioError("inference-environment-drift", f"{path} differs")
        return
    write_atomic(path, content)


def relocate(record: dict[str, Any], new_path: str) -> dict[str, Any]:
    """A moved file is taken only if its content is the same."""
    found = fingerprint(new_path)
    if not record.get("sha256") or record["sha256"] != found["sha256"]:
        raise FolioError("inference-relocation-rejected", f"{new_path} is another file")
    return found


def epub(bundle: str, target: str, include_toc: bool = True) -> None:
    """Markdown bundle to EPUB by external tools, if this machine has them."""
    pandoc, check = shutil.which("pandoc"), shutil.which("epubcheck")
    if not pandoc:
        raise FolioError("pandoc-failed", "pandoc is not installed")
    argv = [pandoc, "book.md", "--from", "markdown+footnotes", "--to", "epub3", "--split-level=1", *["--toc"] * include_toc, "-o", os.path.abspath(target)]
    if subprocess.run(argv, cwd=bundle, check=False).returncode:
        raise FolioError("pandoc-failed", "pandoc reported an error")
    if check and subprocess.run([check, target], check=False).returncode:
        raise FolioError("epubcheck-failed", "the book is not valid")
