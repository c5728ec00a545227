"""Files of a folder, byte ranges of them, and reads at any place; the same code on the driver and in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs

BLOCK = 1 << 20
# Read past the end of a range, where only the rest of one record is wanted.
TAIL = 1 << 16
# What opening a file counts for, and the work of a task, in bytes.
OPEN, WORK = 1 << 16, 64 << 20


def locate(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what stands before such a path in a URI)."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    if "://" not in path:
        return pafs.LocalFileSystem(), path, "file:"
    system, inner = pafs.FileSystem.from_uri(path)
    scheme, rest = path.split("://", 1)
    return system, inner, f"{scheme}://" + (rest.split("/", 1)[0] if inner.startswith("/") else "")


def full_path(path: str) -> str:
    """A path as the readers name it."""
    _, inner, before = locate(path)
    return before + inner


def list_files(path: str, glob: str) -> list[tuple[str, int, int]]:
    """(URI, bytes, time of change in nanoseconds) of the files under a folder, or of one file, by URI; hidden names are left out."""
    system, inner, before = locate(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    root = inner.rstrip("/")
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner, recursive=True))
    out = []
    for one in found:
        below = one.path[len(root):].strip("/").split("/")
        hidden = any(part.startswith((".", "_")) and "=" not in part for part in below)
        if one.type == pafs.FileType.File and (one is info or not hidden and fnmatch(one.base_name, glob)):
            out.append((before + one.path, one.size, one.mtime_ns or 0))
    return sorted(out)


def ranges(files: list[tuple[str, int]], split_bytes: int) -> list[list[tuple[str, int, int, int]]]:
    """Groups of (URI, first byte, byte after the last, bytes of the file): ranges start at multiples of ``split_bytes``, small files share a group."""
    groups: list[list[tuple[str, int, int, int]]] = []
    room = 0
    for uri, size in files:
        for start in range(0, max(size, 1), split_bytes):
            stop = min(size, start + split_bytes)
            if room < stop - start or not groups:
                groups.append([])
                room = split_bytes
            groups[-1].append((uri, start, stop, size))
            room -= max(stop - start, 4096)
    return groups


def task_count(sizes: list[int], parallelism: int) -> int:
    """Tasks for some ranges of files by their work, bytes and opened files: neither a task a small file nor few tasks for large ones."""
    work = sum(sizes) + OPEN * len(sizes)
    return max(1, min(len(sizes), max(4 * parallelism, -(-work // WORK))))


def open_file(uri: str) -> pa.NativeFile:
    """A file to write, replacing what there is; its folder is made if need be."""
    system, inner, _ = locate(uri)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner, buffer_size=BLOCK)


def write_file(uri: str, body: bytes) -> None:
    """Write a whole file, replacing it."""
    with open_file(uri) as out:
        out.write(body)


class Reader:
    """Bytes of one file at any place."""

    def __init__(self, uri: str) -> None:
        system, inner, _ = locate(uri)
        self.file = system.open_input_file(inner)

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def read(self, start: int, stop: int) -> bytes:
        """The bytes from ``start`` on, before ``stop`` or the file's end."""
        return self.file.read_at(stop - start, start) if stop > start else b""

    def find(self, mark: bytes, start: int, size: int) -> int:
        """First place of ``mark`` from ``start`` on, -1 without one."""
        held, base = b"", start
        while base + len(held) < size:
            more = self.read(base + len(held), min(size, base + len(held) + TAIL))
            if not more:
                return -1
            held += more
            at = held.find(mark)
            if at >= 0:
                return base + at
            base, held = base + len(held) - len(mark) + 1, held[len(held) - len(mark) + 1:]
        return -1

    def records(self, mark: bytes, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes]]:
        """(place, bytes) of the records that begin in a range; a record begins with the last byte of each ``mark``, or with the file.

        Bytes are read once, front to back; the last record is read to its end.
        """
        begin = 0
        if start:
            at = self.find(mark, max(0, start - len(mark) + 1), size)
            begin = at + len(mark) - 1 if at >= 0 else size
        if begin >= stop:
            return
        held, base, seen = bytearray(), begin, 0
        while True:
            at = held.find(mark, seen)
            if at < 0:
                seen = max(0, len(held) - len(mark) + 1)
                here = base + len(held)
                more = self.read(here, min(size, here + (BLOCK if here < stop else TAIL)))
                if not more:
                    if held:
                        yield begin, bytes(held)
                    return
                held += more
                continue
            cut = at + len(mark) - 1
            yield begin, bytes(held[:cut])
            begin = base + cut
            if begin >= stop:
                return
            del held[:cut]
            base, seen = begin, 1
