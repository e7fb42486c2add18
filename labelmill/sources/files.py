"""Files that tasks open themselves, by the URI that Spark knows them by."""

from __future__ import annotations

from collections.abc import Iterator

# Bytes of files that one Arrow batch holds; a larger file is a batch of its own.
BATCH_BYTES = 8 << 20


def located(uri: str):
    """The Arrow filesystem of a URI, and the path in it. Spark writes local ones as /x, file:/x or file:///x."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_whole(filesystem, path: str, data: bytes) -> None:
    """A file that is either there with all its bytes or not there: written beside its place, then moved."""
    import uuid

    beside = f"{path}.{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(beside) as out:
        out.write(data)
    filesystem.move(beside, path)


def entries(filesystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Path and whether it is a folder of all that lies in ``folder``, without what Spark's readers pass over as hidden.

    A local folder is read entry by entry, whatever its size.
    """
    import os

    from pyarrow import fs

    if isinstance(filesystem, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            every = ((f"{folder.rstrip('/')}/{entry.name}", entry.is_dir()) for entry in found)
            yield from (item for item in every if not hidden(item[0]))
    else:
        for info in filesystem.get_file_info(fs.FileSelector(folder)):
            if not hidden(info.path):
                yield info.path, info.type == fs.FileType.Directory


def hidden(path: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def files_below(filesystem, folder: str) -> Iterator[str]:
    """Every file in ``folder`` and the folders in it."""
    folders = [folder]
    while folders:
        for path, is_folder in entries(filesystem, folders.pop()):
            if is_folder:
                folders.append(path)
            else:
                yield path


def bounded(rows: Iterator[tuple], schema) -> Iterator:
    """Rows whose last value is a file's bytes, or null, as record batches of about ``BATCH_BYTES``."""
    import pyarrow as pa

    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[-1] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*some), schema)], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*some), schema)], schema=schema)
