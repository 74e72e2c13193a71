"""Files below a path of any store that Arrow opens, and writers whose files are listed only once a job is done."""

from __future__ import annotations

import fnmatch
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import WriterCommitMessage


def open_uri(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def infos(path: str, pattern: str = "*.las,*.laz", recursive: bool = False) -> list[pa.fs.FileInfo]:
    """The files below path whose names fit one of the patterns, whatever their case; each once."""
    fs, inner = open_uri(path)
    info = fs.get_file_info(inner)
    if info.is_file:
        return [info]
    fits = [re.compile(fnmatch.translate(x.strip().lower())).match for x in pattern.split(",")]
    found = fs.get_file_info(pa.fs.FileSelector(inner, recursive=recursive, allow_not_found=True))
    hidden = lambda f: any(x.startswith(("_", ".")) for x in f.path[len(inner) :].strip("/").split("/"))
    return [f for f in found if f.is_file and not hidden(f) and any(fit(f.base_name.lower()) for fit in fits)]


def same_store(path: str, inner: str) -> str:
    return path.partition("://")[0] + "://" + inner if "://" in path else inner


def files_below(path: str, pattern: str = "*.las,*.laz", recursive: bool = False) -> list[str]:
    return [same_store(path, f) for f in sorted(i.path for i in infos(path, pattern, recursive))]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Staged:
    """Tasks write to a folder that no listing shows; the driver moves the files of those that count once all are done. What a lost or
    repeated task leaves goes with that folder, and so does all of a job that fails."""

    def __init__(self, path: str, overwrite: bool, pattern: str):
        self.path, self.overwrite, self.pattern = path.rstrip("/"), overwrite, pattern
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def staged(self, name: str):
        """A stream to a new file."""
        fs, inner = open_uri(f"{self.staging}/{name}")
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(inner)

    def commit(self, messages: list[Written | None]) -> None:
        new = [n for m in messages if m for n in m.files]
        old = set(files_below(self.path, self.pattern)) if self.overwrite else set()
        for name in new:
            fs, inner = open_uri(f"{self.staging}/{name}")
            to = open_uri(f"{self.path}/{self.public(name)}")[1]
            fs.move(inner, to)
            old.discard(same_store(self.path, to))
        for file in old:
            fs, inner = open_uri(file)
            fs.delete_file(inner)
        self._clear()

    def public(self, name: str) -> str:
        """The name that a written file gets."""
        return name

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, inner = open_uri(self.staging)
        if fs.get_file_info(inner).type == pa.fs.FileType.Directory:
            fs.delete_dir(inner)
