"""Files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder such as ``file:///data``, ``hdfs://host/data`` or an absolute path."""
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, suffix: str, parts: list[bytes]) -> str:
    """Write a new file and give its name. Each attempt of a task has a file of its own; only the rows of the attempt that
    Spark accepts name it, so a file that a lost attempt left is never read."""
    system, path = located(folder)
    system.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        for part in parts:
            out.write(part)
    return name


def read_range(folder: str, name: str, start: int, size: int) -> bytes:
    system, path = located(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        f.seek(start)
        return f.read(size)


def read_file(folder: str, name: str) -> bytes:
    system, path = located(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return f.read()
