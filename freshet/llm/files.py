"""Files in the shared folder, written and read by tasks through Arrow's file systems."""

from __future__ import annotations

import contextlib
import uuid


def opened(uri: str):
    """The file system and path of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def written(uri: str):
    """A binary stream to ``uri``. The file appears whole at the end, so a retried or doubled task does no harm."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    stream = system.open_output_stream(part, compression=None)
    try:
        yield stream
    except BaseException:
        stream.close()
        system.delete_file(part)
        raise
    stream.close()
    system.move(part, path)
