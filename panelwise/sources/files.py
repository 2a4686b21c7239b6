"""File access from Python workers, through whatever file system the URI names."""

from __future__ import annotations

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path for a URI; plain and `file:/` paths are local."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri[len("file:"):]
    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri)


def discard(uri: str) -> None:
    """Delete a directory of scratch tables."""
    system, path = resolve(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def read_range(handle, start: int, size: int) -> bytes:
    """Up to `size` bytes from `start`; fewer only at the end of the file."""
    handle.seek(start)
    return handle.read(size)
