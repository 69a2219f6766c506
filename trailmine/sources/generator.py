"""Transcripts for tests and benches, the same for the same seed."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta, timezone

#: How often each kind of session is drawn, fixed values.
MIX = {"feature": 3, "friction": 2, "explore": 1, "helper": 1}


class _Session:
    def __init__(self, rng: random.Random, project: str, name: str):
        self.rng, self.project, self.name = rng, project, name
        self.at = datetime(2025, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=rng.randrange(10**7))
        self.main: list[dict] = []
        self.helper: list[dict] = []
        self.calls = 0

    def line(self, to: list[dict], kind: str, content) -> None:
        self.at += timedelta(seconds=self.rng.randrange(1, 20))
        to.append({"type": kind, "uuid": f"{self.name}-{len(self.main)}-{len(self.helper)}", "sessionId": self.name, "timestamp": self.at.isoformat().replace("+00:00", "Z"), "version": "1.0", "isSidechain": to is self.helper, "message": {"role": kind, "content": content}})

    def ask(self, text: str) -> None:
        self.line(self.main, "user", text)

    def call(self, tool: str, given: dict, fails: bool = False, to: list[dict] | None = None) -> None:
        to = self.main if to is None else to
        self.calls += 1
        key = f"{self.name}-call-{self.calls}"
        self.line(to, "assistant", [{"type": "tool_use", "id": key, "name": tool, "input": given}])
        self.line(to, "user", [{"type": "tool_result", "tool_use_id": key, "is_error": fails, "content": "failed" if fails else "done " * self.rng.randrange(1, 9)}])

    def file(self) -> str:
        return f"src/part{self.rng.randrange(6)}.go"

    def feature(self) -> None:
        self.ask("Please add the option.")
        for _ in range(self.rng.randrange(2, 5)):
            f = self.file()
            self.call("Read", {"file_path": f})
            self.call("Edit", {"file_path": f})
            self.call("Bash", {"command": "go test ./..."})
            self.call("Bash", {"command": "git add . && git commit -m step"})

    def friction(self) -> None:
        self.ask("The tests fail.")
        for k in range(self.rng.randrange(2, 5)):
            self.call("Bash", {"command": "go test ./..."}, fails=k != 3)
            self.call("Edit", {"file_path": self.file()})

    def explore(self) -> None:
        self.ask("Where is the limit set?")
        for _ in range(self.rng.randrange(3, 8)):
            self.call("Grep", {"pattern": "limit"})
            self.call("Read", {"file_path": self.file()})

    def helper_(self) -> None:
        self.ask("Look into it with a helper.")
        self.call("Task", {"subagent_type": "scout"})
        for _ in range(3):
            self.call("Grep", {"pattern": "x"}, to=self.helper)
            self.call("Read", {"file_path": self.file()}, to=self.helper)

    def save(self, out: str) -> None:
        """The helper's file first: a session file without it never stays behind."""
        folder = os.path.join(out, self.project)
        if self.helper:
            sub = os.path.join(folder, self.name, "subagents")
            os.makedirs(sub, exist_ok=True)
            _write(os.path.join(sub, "agent-1.jsonl"), self.helper)
        os.makedirs(folder, exist_ok=True)
        _write(os.path.join(folder, f"{self.name}.jsonl"), self.main)


def _write(path: str, lines: list[dict]) -> None:
    with open(path + ".tmp", "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in lines)
    os.replace(path + ".tmp", path)


def generate(out: str, project: str = "demo", sessions: int = 60, seed: int = 1) -> None:
    """Writes transcripts of `sessions` sessions below out/project."""
    rng = random.Random(seed)
    kinds = [k for k, n in MIX.items() for _ in range(n)]
    for n in range(sessions):
        s = _Session(rng, project, f"session-{n:05d}")
        {"feature": s.feature, "friction": s.friction, "explore": s.explore, "helper": s.helper_}[rng.choice(kinds)]()
        s.save(out)
