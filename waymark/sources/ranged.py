"""Files read by ranges and in chunks, so that no task holds one whole: on any file system that Arrow knows by its URI."""

from __future__ import annotations

import codecs
import io
import json
import re
from collections.abc import Iterator

#: Schemes that Arrow reads; files elsewhere are read whole, through Spark.
SCHEMES = {"", "file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss"}
CHUNK, MOST_HEAD, MOST_ROW = 64 << 10, 1 << 20, 4 << 20


def can_seek(path: str) -> bool:
    """Whether files under the path can be read by ranges."""
    found = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):", path)
    return (found[1].lower() if found else "") in SCHEMES


class _Seekable(io.RawIOBase):
    """An Arrow file as Python's: a seek to before its start is an OSError."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def read(self, n=-1):
        return self.file.read(None if n is None or n < 0 else n)

    def readall(self):
        return self.read()

    def tell(self):
        return self.file.tell()

    def seek(self, at, whence=0):
        place = at + (0, self.file.tell(), self.file.size())[whence]
        if place < 0:
            raise OSError("before the start of the file")
        return self.file.seek(place)

    def close(self):
        self.file.close()
        super().close()


def opened(path: str) -> io.RawIOBase:
    """The file at a path or URI, to be read from anywhere in it."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(re.sub(r"^(file:)?/(?!/)", "file:///", path))
    return _Seekable(system.open_input_file(at))


class _Text:
    """Text of a stream of bytes, a chunk at a time; what has been used is let go."""

    def __init__(self, stream):
        self.stream, self.decoder, self.text, self.ended = stream, codecs.getincrementaldecoder("utf-8")("replace"), "", False

    def more(self) -> bool:
        """Reads on; whether there was more."""
        if self.ended:
            return False
        data = self.stream.read(CHUNK)
        self.ended = not data
        self.text += self.decoder.decode(data, self.ended)
        return not self.ended

    def drop(self, n: int) -> None:
        self.text = self.text[n:]


def array_rows(stream, inner_key: str) -> Iterator[tuple[dict | None, bool]]:
    """The objects of the array that a JSON file opens with, or of the one under inner_key in its first object, as they
    are read; at the end, or at the first fault, (None, whether the array was read whole). A row of more than MOST_ROW
    characters is a fault; other values than objects are passed over."""
    said, decoder = _Text(stream), json.JSONDecoder()
    under = re.compile(rf'"{re.escape(inner_key)}"\s*:\s*\S')
    while len(said.text) < MOST_HEAD and not under.search(said.text) and said.more():
        pass
    text = said.text.removeprefix("﻿")
    at = text.find("[")
    if at < 0:
        return
    inner = text.find("[", at + 1)
    if inner >= 0 and f'"{inner_key}"' in text[at:inner]:
        at = inner
    said.text = text[at + 1 :]
    while True:
        blank = len(said.text) - len(said.text.lstrip(" \t\r\n,"))
        said.drop(blank)
        if not said.text:
            if not said.more():
                yield None, False
                return
            continue
        if said.text[0] == "]":
            yield None, True
            return
        try:
            row, end = decoder.raw_decode(said.text)
            if end == len(said.text) and said.more():
                continue  # a number may go on in the next chunk
        except json.JSONDecodeError:
            if len(said.text) > MOST_ROW or not said.more():
                yield None, False
                return
            continue
        said.drop(end)
        if isinstance(row, dict):
            yield row, True
