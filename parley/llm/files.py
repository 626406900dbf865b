"""Files in shared folders, from Python workers: any store that pyarrow's file systems reach by URI."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and its path for a URI, of Spark's form file:/x too."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class Reader:
    """Range reads; keeps the last few files open."""

    def __init__(self, most: int = 8):
        self.most, self.files = most, {}

    def file(self, uri: str):
        if uri not in self.files:
            if len(self.files) >= self.most:
                self.files.pop(next(iter(self.files))).close()
            store, path = opened(uri)
            self.files[uri] = store.open_input_file(path)
        return self.files[uri]

    def size(self, uri: str) -> int:
        return self.file(uri).size()

    def at(self, uri: str, offset: int, length: int) -> bytes:
        data = self.file(uri).read_at(length, offset)
        if len(data) != length:
            raise EOFError(f"{uri}: {len(data)} of {length} bytes at {offset}")
        return data
