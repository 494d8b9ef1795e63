"""Where a path or URI points, for tasks that open files themselves."""

from __future__ import annotations

import os
import re
import sys
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark import cloudpickle

# Goes to the tasks with their code, so that it works where the package is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def local_path(path: str) -> str:
    """The path of a `file:` URI; paths pass as they are, other schemes raise."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*|(?<=file:)(?=/))", path)
    if not found:
        return path
    if found[1].lower() != "file":
        raise ValueError(f"{path} is not local to the executors; use read_binary_files for {found[1]}")
    return unquote(path[found.end() :])


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a URI that pyarrow can open, or of a path."""
    if re.match(r"file:/|[A-Za-z][A-Za-z0-9+.-]*://", uri):
        uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", uri))
        uri = quote(uri, safe="%/:?#[]@!$&'()*+,;=~-._")  # Spark leaves letters as they are
        try:
            store, folder = fs.FileSystem.from_uri(uri)
        except (OSError, ValueError) as fault:
            raise ValueError(f"cannot open {uri}") from fault
    else:
        store, folder = fs.LocalFileSystem(), os.path.abspath(uri)
    return store, folder.rstrip("/")


def folder_of(base: str, bundle: str) -> str:
    """The folder that a bundle's files get under `base`: its quoted name, if it has one."""
    name = quote(bundle, safe="")
    if not name.strip("."):
        name = name.replace(".", "%2E")  # no folder may be `.` or `..`
    return f"{base}/{name}" if name else base
