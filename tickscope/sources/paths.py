"""Files inside tasks, their first or last bytes, their making and their removal, for the path schemes that Spark names and pyarrow does not."""

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

# Spark's name of a file system to pyarrow's; object stores have several in use
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "abfs": "abfs", "wasbs": "abfss", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs"}
LOCAL_MOUNTS = {"dbfs": "/dbfs"}


def normalize(uri: str) -> str:
    """``file:/x`` and ``scheme:/x`` forms and scheme names as pyarrow reads them."""
    scheme, sep, rest = uri.partition(":")
    if not sep or "/" in scheme:
        return uri
    if scheme in LOCAL_MOUNTS:
        return LOCAL_MOUNTS[scheme] + "/" + rest.lstrip("/")
    if not rest.startswith("//"):
        rest = "//" + rest
    return SCHEMES.get(scheme, scheme) + ":" + rest


def _located(uri: str):
    """(file system, path in it). ``uri`` is a path as listings show it: letters that an address would escape stand for themselves."""
    from urllib.parse import quote

    from pyarrow import fs

    path = normalize(uri)
    if path.startswith("file://"):
        path = path[len("file://"):]
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(quote(path, safe="/:@"))


def open_file(uri: str):
    """Random-access file of any scheme."""
    system, path = _located(uri)
    return system.open_input_file(path)


@contextmanager
def new_file(uri: str) -> Iterator:
    """Output stream of a file that appears under its name once it is whole, in place of one that has the name; folders above it are made. A task that is
    repeated leaves the same files, and what a lost one began is hidden."""
    system, path = _located(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    begun = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(begun, compression=None) as out:
        yield out
    system.move(begun, path)


def partition_folder(column: str, value: str | None) -> str:
    """Name of the folder of a value, escaped as Spark escapes it."""
    if not value:
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}=" + re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", value)


def delete_folder(uri: str) -> bool:
    """Remove a folder and what is in it; one that is not there is no error. Was it there?"""
    system, path = _located(uri)
    try:
        system.delete_dir(path)
    except FileNotFoundError:
        return False
    return True


def delete_others(uri: str, name: str) -> None:
    """Remove the files of a folder that are not hidden and not called ``name``; files that are gone already are no error."""
    from pyarrow import fs

    system, folder = _located(uri)
    for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if f.type == fs.FileType.File and f.base_name != name and f.base_name[0] not in "._":
            try:
                system.delete_file(f.path)
            except FileNotFoundError:
                pass


def listing(uri: str) -> list[tuple]:
    """(path, time of change, length) of all files below ``uri``, hidden ones left out and times cut to milliseconds as Spark
    does, in the order of paths."""
    from pyarrow import fs

    system, root = _located(uri)
    prefix = "file:" if isinstance(system, fs.LocalFileSystem) else uri.split("://", 1)[0] + "://"
    found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    hidden = [any(part[0] in "._" for part in f.path[len(root):].split("/") if part) for f in found]
    return sorted((prefix + f.path, f.mtime.replace(microsecond=f.mtime.microsecond // 1000 * 1000), f.size) for f, skip in zip(found, hidden) if not skip)


def folder_entries(uri: str) -> list[tuple]:
    """(path, time of change, length, is it a folder) of what lies in one folder itself: no hidden names, times cut to milliseconds, and addresses as Spark's
    listings show them. A folder that has gone since it was seen is empty."""
    from pyarrow import fs

    system, root = _located(uri)
    above = ("file:" + root if isinstance(system, fs.LocalFileSystem) else uri).rstrip("/")
    found = [f for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True))
             if f.base_name[0] != "." and (f.base_name[0] != "_" or "=" in f.base_name) and not f.base_name.endswith("._COPYING_")]
    return [(f"{above}/{f.base_name}", f.mtime.replace(microsecond=f.mtime.microsecond // 1000 * 1000), f.size, False) if f.type == fs.FileType.File
            else (f"{above}/{f.base_name}", None, None, True) for f in found if f.type in (fs.FileType.File, fs.FileType.Directory)]
