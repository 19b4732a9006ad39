"""The workspace folder: atomic writes below one root, and the manifest of a run."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Iterable
from datetime import datetime, timezone
from pathlib import Path

from lodestone.streaming.events import EventBus, StorageWritten, WorkspaceInitialized


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Workspace:
    """Files of one project's runs; paths that leave the folder raise."""

    def __init__(self, root: str | Path, bus: EventBus | None = None):
        self.root, self.bus = Path(root).resolve(), bus or EventBus()

    def path(self, relative: str) -> Path:
        p = (self.root / relative).resolve()
        if p != self.root and self.root not in p.parents:
            raise ValueError(f"{relative} is outside the workspace")
        return p

    def exists(self) -> bool:
        return (self.root / "workspace.json").exists()

    def init(self, project: str, force: bool = False) -> None:
        if self.exists() and not force:
            raise FileExistsError(f"{self.root} exists")
        if self.root.exists() and force:
            shutil.rmtree(self.root)
        for folder in ("logs", "cache", "staging"):
            (self.root / folder).mkdir(parents=True, exist_ok=True)
        self.write_json("workspace.json", {"project": project, "schema_version": "1", "created_at": now(), "updated_at": now(), "artifacts": []})
        self.bus.publish(WorkspaceInitialized(path=str(self.root)))

    def write_lines(self, relative: str, lines: Iterable[str]) -> None:
        """Written beside the target, synced, then moved over it, so that readers see the old file or the new one."""
        target = self.path(relative)
        target.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=target.parent, prefix=".part-")
        try:
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                for line in lines:
                    f.write(line)
                    f.write("\n")
                f.flush()
                os.fsync(f.fileno())
            os.replace(name, target)
        except BaseException:
            os.unlink(name)
            raise
        self.bus.publish(StorageWritten(path=relative))

    def write_json(self, relative: str, data: object) -> None:
        self.write_lines(relative, [json.dumps(data, indent=2, ensure_ascii=False)])

    def append_json(self, relative: str, record: object) -> None:
        target = self.path(relative)
        target.parent.mkdir(parents=True, exist_ok=True)
        with target.open("a", encoding="utf-8") as f:
            f.write(json.dumps(record, ensure_ascii=False) + "\n")

    def read_json(self, relative: str) -> object:
        return json.loads(self.path(relative).read_text("utf-8"))

    def read_jsonl(self, relative: str) -> list:
        """Records of a small file; none if it is missing; blank lines are skipped."""
        p = self.path(relative)
        return [json.loads(x) for x in p.read_text("utf-8").splitlines() if x.strip()] if p.exists() else []

    def unit(self) -> UnitOfWork:
        return UnitOfWork(self)


class UnitOfWork:
    """Stages files and moves them all into place with the manifest on commit; leaving the block early drops them."""

    def __init__(self, workspace: Workspace):
        self.workspace, self.staged = workspace, {}

    def stage(self, relative: str, text: str) -> None:
        self.workspace.path(relative)
        name = f"staging/{len(self.staged)}"
        self.workspace.write_lines(name, [text])
        self.staged[relative] = name

    def commit(self) -> None:
        for relative, name in self.staged.items():
            target = self.workspace.path(relative)
            target.parent.mkdir(parents=True, exist_ok=True)
            os.replace(self.workspace.path(name), target)
        manifest = self.workspace.read_json("workspace.json")
        manifest |= {"updated_at": now(), "artifacts": sorted({*manifest["artifacts"], *self.staged})}
        self.workspace.write_json("workspace.json", manifest)
        self.staged = {}

    def rollback(self) -> None:
        for name in self.staged.values():
            self.workspace.path(name).unlink(missing_ok=True)
        self.staged = {}

    def __enter__(self) -> UnitOfWork:
        return self

    def __exit__(self, *exc) -> None:
        self.rollback()
