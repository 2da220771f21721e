"""Publishing an output folder as a whole, and putting things right after a crash.

Beside the folder stand, while it is being replaced, a candidate, the previous folder and a marker
that names the phase. What to do after a crash is looked up in the tables of ``operators.store``,
by what exists and what is valid; here the looked-up actions are carried out. Nothing is deleted
that might be the only good copy: what is invalid or unexpected goes to ``quarantine``.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import secrets
import shutil
from collections.abc import Callable
from typing import Any

from folio.errors import FolioError
from folio.operators.store import RAISE, RECOVERY
from folio.plans.runs import write_atomic

MARKER_VERSION = 1  # fixed value
PHASES = tuple(dict.fromkeys(row[0] for row in RECOVERY))

#: What each action does with d(estination), c(andidate) and p(revious), in order: q sets aside, > moves, x drops.
STEPS: dict[str, str] = {
    "quarantine-candidate": "qc", "quarantine-candidate-raise": "qc !", "quarantine-candidate-keep": "qc", "quarantine-both": "qd qc qp",
    "quarantine-destination": "qd", "quarantine-previous": "qp", "keep-destination": "", "keep-destination-drop-previous": "xp", "finish": "xc xp",
    "publish-candidate": "c>d", "publish-candidate-replace": "d>p c>d xp", "publish-candidate-drop-previous": "c>d xp",
    "restore-previous": "p>d", "quarantine-candidate-restore-previous": "qc p>d", "quarantine-destination-restore-previous": "qd p>d",
    "quarantine-all-raise": "qd qc qp !", RAISE: "!",
}


def tree_problem(folder: str, command: str, primary: str, head: int | None = None) -> str | None:
    """Why an output folder is not what its manifest says, or None."""
    try:
        with open(os.path.join(folder, "manifest.json")) as file:
            manifest = json.load(file)
        listed = {entry["path"]: (entry["size_bytes"], entry["sha256"]) for entry in manifest["files"]}
    except (OSError, ValueError, KeyError, TypeError) as e:
        return f"manifest: {e}"
    if manifest.get("command") != command or len(listed) != len(manifest["files"]):
        return "another command, or a path twice"
    if head is not None and manifest.get("committed_page_count") != head:
        return "made at another head"
    names = [re.fullmatch(r"assets/([0-9a-f]{64})\.png", path) for path in listed if path != primary]
    if primary not in listed or not all(names) or any(m.group(1) != listed[m.group(0)][1] for m in names if m):
        return "not one primary file and assets named by their hashes"
    found = set()
    for at, folders, files in os.walk(folder):
        if any(os.path.islink(os.path.join(at, x)) for x in (*folders, *files)) or not (folders or files):
            return "a symbolic link or an empty folder"
        found |= {os.path.relpath(os.path.join(at, x), folder) for x in files}
    if found - {"manifest.json"} != set(listed):
        return "files and manifest differ"
    for path, (size, sha) in listed.items():
        digest = hashlib.sha256()
        with open(os.path.join(folder, path), "rb") as file:
            while piece := file.read(1 << 20):
                digest.update(piece)
        if os.path.getsize(os.path.join(folder, path)) != size or digest.hexdigest() != sha:
            return f"{path} differs"
    return None


class Output:
    """One output folder and what stands beside it. ``command`` and ``primary`` say what it has to hold."""

    def __init__(self, folder: str, command: str = "markdown", primary: str = "book.md", pause: Callable[[str], None] = lambda step: None):
        self.folder, self.command, self.primary, self.pause = folder.rstrip("/"), command, primary, pause
        self.base, self.name = os.path.split(self.folder)
        self.marker_path, self.previous = f"{self.folder}.transaction.json", f"{self.folder}.previous"

    def valid(self, path: str | None, head: int | None = None) -> bool:
        return bool(path) and os.path.isdir(path) and not os.path.islink(path) and tree_problem(path, self.command, self.primary, head) is None

    def set_aside(self, path: str | None) -> None:
        """To the quarantine, under the next free number."""
        if path and os.path.lexists(path):
            area = os.path.join(self.base, "quarantine")
            os.makedirs(area, exist_ok=True)
            number = 1 + max((int(m.group(1)) for x in os.listdir(area) if (m := re.match(r"(\d{4,})-", x))), default=0)
            os.rename(path, os.path.join(area, f"{number:04d}-{os.path.basename(path)}"))

    def _drop(self, path: str | None) -> None:
        if path and os.path.isdir(path) and not os.path.islink(path):
            shutil.rmtree(path)
        elif path and os.path.lexists(path):
            os.unlink(path)

    def _mark(self, phase: str, candidate: str, head: int | None) -> None:
        record = {"version": MARKER_VERSION, "command": self.command, "phase": phase, "candidate": os.path.basename(candidate), "head": head}
        write_atomic(self.marker_path, json.dumps(record, sort_keys=True).encode())
        self.pause(f"marked {phase}")

    def _candidates(self) -> list[str]:
        pattern = re.compile(re.escape(self.name) + r"\.candidate\.[0-9a-f]{16}")
        return [os.path.join(self.base, x) for x in sorted(os.listdir(self.base or ".")) if pattern.fullmatch(x)]

    def marker(self) -> dict[str, Any] | None:
        """The marker if it makes sense; one that does not is set aside, as if there were none."""
        if not os.path.lexists(self.marker_path):
            return None
        record: Any = None
        if os.path.isfile(self.marker_path) and not os.path.islink(self.marker_path):
            try:
                with open(self.marker_path) as file:
                    record = json.load(file)
            except (OSError, ValueError):
                pass
        named = re.compile(re.escape(self.name) + r"\.candidate\.[0-9a-f]{16}")
        if (
            isinstance(record, dict) and record.get("version") == MARKER_VERSION and record.get("command") == self.command and record.get("phase") in PHASES
            and isinstance(record.get("candidate"), str) and named.fullmatch(record["candidate"])
        ):
            return record
        self.set_aside(self.marker_path)
        return None

    def recover(self) -> str | None:
        """Puts right what a crash left, by the tables; the action that was taken, None if nothing was there."""
        record = self.marker()
        if record is None:
            return self._without_marker()
        candidate = os.path.join(self.base, record["candidate"])
        flags = {
            "phase": record["phase"], "has_destination": os.path.lexists(self.folder), "has_candidate": os.path.lexists(candidate), "has_previous": os.path.lexists(self.previous),
            "candidate_valid": self.valid(candidate, record["head"]), "destination_valid": self.valid(self.folder), "destination_valid_at_head": self.valid(self.folder, record["head"]),
            "previous_valid": self.valid(self.previous), "otherwise": True,
        }
        rows = (choices for phase, d, c, p, choices in RECOVERY if phase == flags["phase"] and all(want in (None, flags[name]) for name, want in zip(("has_destination", "has_candidate", "has_previous"), (d, c, p), strict=True)))
        action = next((act for condition, act in next(rows, ()) if flags[condition]), RAISE)
        self._do(STEPS[action], candidate)
        os.unlink(self.marker_path)
        return action

    def _do(self, steps: str, candidate: str) -> None:
        at = {"d": self.folder, "c": candidate, "p": self.previous}
        for step in steps.split():
            if step == "!":
                raise FolioError("output-transaction-corruption", f"{self.folder} and what stands beside it contradict the marker")
            if step[0] == "q":
                self.set_aside(at[step[1]])
            elif step[0] == "x":
                self._drop(at[step[1]])
            else:
                os.rename(at[step[0]], at[step[2]])
            self.pause(step)

    def _without_marker(self) -> str | None:
        taken = [f"quarantine {os.path.basename(c)}" for c in self._candidates()]
        for stray in self._candidates():
            self.set_aside(stray)
        here, valid = os.path.lexists(self.folder), self.valid(self.folder)
        if here and not valid:
            self.set_aside(self.folder)
            taken.append("quarantine-destination")
        if os.path.lexists(self.previous):
            back = not valid and self.valid(self.previous)
            if back:
                os.rename(self.previous, self.folder)
            else:
                self.set_aside(self.previous)
            taken.append("restore-previous" if back else "quarantine-previous")
        return ",".join(taken) or None

    def publish(self, build: Callable[[str], None], head: int | None = None) -> None:
        """Builds a candidate, checks it, and puts it in the place of what is there."""
        os.makedirs(self.base or ".", exist_ok=True)
        self.recover()
        candidate = f"{self.folder}.candidate.{secrets.token_hex(8)}"
        self._mark("building", candidate, head)
        os.makedirs(candidate)
        build(candidate)
        self.pause("built")
        if problem := tree_problem(candidate, self.command, self.primary, head):
            self.set_aside(candidate)
            os.unlink(self.marker_path)
            raise FolioError("invalid-run-layout", problem)
        self._mark("candidate-valid", candidate, head)
        if os.path.lexists(self.folder):
            os.rename(self.folder, self.previous)
            self.pause("moved")
            self._mark("previous-moved", candidate, head)
        os.rename(candidate, self.folder)
        self.pause("published")
        self._mark("candidate-published", candidate, head)
        self._drop(self.previous)
        self.pause("dropped")
        os.unlink(self.marker_path)
