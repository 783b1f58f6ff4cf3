"""Writers of plain files for Spark's Python data source API: tasks write aside, one move of a manifest publishes.

Tasks write their files under ``_temporary/<job>``; when all have ended, the driver moves the files to their places and then
moves a manifest over the old one. Readers take the files that the manifest names, so a job that dies at any point leaves the
table as it was; what it wrote aside is deleted when the job fails, and is never read. Paths are opened with Arrow's file
systems, in a folder that driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "_manifest.json"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}") if ":/" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    return system, at.rstrip("/")


def _exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def listed(path: str, suffix: str) -> list[str]:
    """The files of a table: those its manifest names, else all with the suffix; or the one file that the path is."""
    system, at = opened(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [at]
    if _exists(system, f"{at}/{MANIFEST}"):
        with system.open_input_file(f"{at}/{MANIFEST}") as f:
            return [f"{at}/{name}" for name in json.loads(f.read())["files"]]
    found = system.get_file_info(fs.FileSelector(at, recursive=False))
    return sorted(f.path for f in found if f.base_name.endswith(suffix) and not f.base_name.startswith(("_", ".")))


@dataclass
class Written(WriterCommitMessage):
    """A task's files: where each is, and its name in the table."""

    files: list[tuple[str, str]] = field(default_factory=list)


class TwoPhaseWriter(DataSourceArrowWriter):
    """``parts`` turns a task's batches into (name in the table, bytes); with ``overwrite`` the other files go."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        opened(path)[0].create_dir(self.aside(), recursive=True)  # tasks don't make it, so those that outlive a failed job can't write

    def parts(self, batches: Iterator) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def aside(self) -> str:
        return f"{opened(self.path)[1]}/_temporary/{self.job}"

    def write(self, iterator: Iterator) -> Written:
        system, _ = opened(self.path)
        done = Written()
        try:
            for name, content in self.parts(iterator):
                at = f"{self.aside()}/{uuid.uuid4().hex}"
                done.files.append((at, name))
                with system.open_output_stream(at) as f:
                    f.write(content)
        except BaseException:
            for at, _ in done.files:
                if _exists(system, at):
                    system.delete_file(at)
            raise
        return done

    def commit(self, messages: list) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        old = [f.removeprefix(f"{root}/") for f in listed(self.path, "")] if _exists(system, f"{root}/{MANIFEST}") else []
        new = self.placed(system, root, [f for m in messages if m is not None for f in m.files])
        kept = [] if self.overwrite else [f for f in old if f not in new]
        self.publish(system, root, [*kept, *new])
        for name in set(old) - set(kept) - set(new):
            if _exists(system, f"{root}/{name}"):
                system.delete_file(f"{root}/{name}")
        self._clear(system)

    def placed(self, system: fs.FileSystem, root: str, files: list[tuple[str, str]]) -> list[str]:
        for at, name in files:
            system.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
            system.move(at, f"{root}/{name}")
        return [name for _, name in files]

    def publish(self, system: fs.FileSystem, root: str, names: list[str]) -> None:
        at = f"{root}/_{self.job}.json"
        with system.open_output_stream(at) as f:
            f.write(json.dumps({"files": names}).encode())
        system.move(at, f"{root}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        self._clear(opened(self.path)[0])

    def _clear(self, system: fs.FileSystem) -> None:
        top = self.aside().rsplit("/", 1)[0]
        system.delete_dir(self.aside())
        if not system.get_file_info(fs.FileSelector(top)):
            system.delete_dir(top)
