"""Files by URI: those of file systems that Arrow knows, on driver and executors alike."""

from __future__ import annotations

import fnmatch

#: Names by which file systems are also known.
_SAME = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfss": "abfs"}


def filesystem(uri: str):
    """(file system, path in it). A path without a scheme is local, as is one of dbfs:/, under /dbfs. s3, gs, abfs and hdfs take their
    credentials from the environment. Of other schemes only Spark reads: see binary_records of sources.warc."""
    from pyarrow.fs import FileSystem

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return FileSystem.from_uri(f"file://{uri}")
    if scheme == "dbfs":
        return FileSystem.from_uri("file:///dbfs/" + rest.lstrip("/"))
    if scheme == "file":
        return FileSystem.from_uri("file:///" + rest.lstrip("/"))
    return FileSystem.from_uri(f"{_SAME.get(scheme, scheme)}:{rest}")


def _uri(like: str, path: str) -> str:
    """The URI of a path of the file system of the URI `like`, in that one's form."""
    scheme, colon, rest = like.partition("://")
    if not colon or scheme in ("file", "dbfs"):
        return path
    authority = rest.partition("/")[0]
    if path.startswith("/"):
        return f"{scheme}://{authority}{path}"
    return f"{scheme}://{authority}/" + path.partition("/")[2]


def expand(pattern: str) -> list[str]:
    """The files that a path names, sorted: itself, all in the folder, or those whose names match its wildcards, which may stand in
    any part of the path."""
    from pyarrow.fs import FileSelector, FileType

    fs, path = filesystem(pattern)
    parts = path.split("/")
    wild = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), None)
    if wild is None:
        kind = fs.get_file_info(path).type
        if kind == FileType.File:
            return [_uri(pattern, path)]
        found = fs.get_file_info(FileSelector(path)) if kind == FileType.Directory else []
        return sorted(_uri(pattern, f.path) for f in found if f.type == FileType.File and not f.base_name.startswith(("_", ".")))
    here = ["/".join(parts[:wild]) or "/"]
    for i, part in enumerate(parts[wild:], wild):
        last, found = i == len(parts) - 1, []
        for folder in here:
            for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
                if f.type == (FileType.File if last else FileType.Directory) and fnmatch.fnmatchcase(f.base_name, part):
                    found.append(f.path)
        here = found
    return sorted(_uri(pattern, p) for p in here)
