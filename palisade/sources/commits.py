"""Commit logs: numbered entries of a table's folder that exist completely or not at all."""

from __future__ import annotations

import json
import os
import re

from pyarrow import fs


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if re.match(r"[a-z0-9]+:/", root):
        system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))
        return system, path.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(root)


def entries(root: str) -> dict[int, dict]:
    """The committed entries below ``root`` by number."""
    system, path = opened(f"{root}/commits")
    if system.get_file_info(path).type != fs.FileType.Directory:
        return {}
    out = {}
    for info in system.get_file_info(fs.FileSelector(path)):
        if info.base_name.isdigit():
            with system.open_input_stream(info.path) as handle:
                out[int(info.base_name)] = json.loads(handle.read())
    return out


def commit(root: str, number: int, entry: dict) -> int:
    """Add an entry. It is written beside its name and moved there, so readers see all of it or nothing. One writer at a time."""
    system, path = opened(f"{root}/commits")
    system.create_dir(path, recursive=True)
    final = f"{path}/{number:08d}"
    if system.get_file_info(final).type != fs.FileType.NotFound:
        raise FileExistsError(f"{root} has an entry {number} of another writer")
    with system.open_output_stream(f"{path}/.{number:08d}.part") as handle:
        handle.write(json.dumps(entry).encode())
    system.move(f"{path}/.{number:08d}.part", final)
    return number


def forget(root: str, numbers: list[int]) -> None:
    """Take entries out of the log."""
    system, path = opened(f"{root}/commits")
    for number in numbers:
        system.delete_file(f"{path}/{number:08d}")
