"""Binary files in the folder that driver and executors share.

Spark's writers have no plain binary format, so tasks write such files
themselves, through the file system that the path names (local, HDFS, object
stores). A task that is run again writes files of other names, and only what the
committed table of names lists is read: lost executors leave unread files, and
nothing else.
"""

from __future__ import annotations

from pyarrow.fs import FileSelector, FileSystem, FileType


def opened(path: str) -> tuple[FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(path)


def listed(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The names of a folder's files that end so."""
    files, inside = opened(path)
    return sorted(f.base_name for f in files.get_file_info(FileSelector(inside)) if f.type == FileType.File and f.base_name.endswith(suffixes))
