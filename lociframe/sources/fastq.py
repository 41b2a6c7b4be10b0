"""FASTQ as a Python data source that splits large files at record boundaries."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES = 64 << 20


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        files, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    else:
        files, inner = fs.LocalFileSystem(), path
    return files, inner


def _lines_from(stream, start: int) -> Iterator[tuple[int, bytes]]:
    at = start
    for line in stream:
        yield at, line
        at += len(line)


def _first_record(lines: list[bytes]) -> int | None:
    """Number of the line that opens a record: ``@``, then letters, ``+`` and a quality as long as the letters.

    ``@`` may open a quality line too, so all four lines are looked at.
    """
    for i in range(len(lines) - 3):
        four = [x.rstrip(b"\r\n") for x in lines[i : i + 4]]
        if four[0][:1] == b"@" and four[2][:1] == b"+" and len(four[1]) == len(four[3]):
            return i
    return None


class FastqSource(DataSource):
    """Options: ``paths`` (one per line) and ``part_bytes``. A name shorter than two characters (with its
    ``@``) or a record that breaks off is an error that names the file and the place. Empty lines between
    records are skipped. ``ordinal`` counts the records of a part, which starts at byte ``part_start``."""

    @classmethod
    def name(cls) -> str:
        return "lociframe_fastq"

    def schema(self) -> str:
        return "name string, seq string, qual string, ordinal bigint, file_name string, part_start bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in (options.get("paths") or options.get("path", "")).split("\n") if p]
        self.part = int(options.get("part_bytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for path in self.paths:
            files, inner = _open(path)
            info = files.get_file_info(inner)
            if not info.is_file:
                raise FileNotFoundError(path)
            if path.endswith(".gz") or info.size <= self.part:
                parts.append(_Part(path, 0, None))
            else:
                parts += [_Part(path, at, min(at + self.part, info.size)) for at in range(0, info.size, self.part)]
        return parts

    def read(self, part: _Part) -> Iterator[tuple]:
        files, inner = _open(part.path)
        with files.open_input_file(inner) as raw:
            raw.seek(max(0, part.start - 1))
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if part.path.endswith(".gz") else raw, 1 << 20)
            lines = _lines_from(stream, part.start)
            ahead: list[tuple[int, bytes]] = []
            if part.start:
                broken = stream.readline()  # the rest of a line that began before, or the line break itself
                lines = _lines_from(stream, part.start - 1 + len(broken))
                skip = None
                for x in lines:
                    ahead.append(x)
                    skip = _first_record([y for _, y in ahead[-4:]])
                    if skip is not None or len(ahead) >= 4 and ahead[-4][0] >= part.end:
                        break
                own = [x for at, x in (ahead if skip is None else ahead[:-4]) if at < part.end and x.strip()]
                if len(own) > 3:  # more than the rest of a record that began before
                    raise ValueError(f"FASTQ syntax error in {part.path}: lines of no record from byte {part.start} on")
                if skip is None:
                    return
                ahead = ahead[-4:]
            number = 0
            source = iter(ahead)

            def following():
                nonlocal source
                for x in source:
                    yield x
                yield from lines

            queue = following()
            for at, head in queue:
                if not head.strip():
                    continue
                if part.end is not None and at >= part.end:
                    return
                body = [next(queue, (0, b""))[1].rstrip(b"\r\n").decode() for _ in range(3)]
                name = head.rstrip(b"\r\n").decode()
                if name[:1] != "@" or len(name) < 2 or body[1][:1] != "+":
                    raise ValueError(f"FASTQ syntax error in {part.path} at byte {at}: {name[:60]!r}")
                yield name[1:], body[0], body[2], number, part.path, part.start
                number += 1


class LineSource(DataSource):
    """Lines of text files, large ones split: ``line``, ``ordinal`` (of the line in its part), ``file_name`` and ``part_start``.
    Options as for :class:`FastqSource`. A closing line break ends the last line."""

    @classmethod
    def name(cls) -> str:
        return "lociframe_lines"

    def schema(self) -> str:
        return "line string, ordinal bigint, file_name string, part_start bigint"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


class _LineReader(_Reader):
    def read(self, part: _Part) -> Iterator[tuple]:
        files, inner = _open(part.path)
        with files.open_input_file(inner) as raw:
            raw.seek(max(0, part.start - 1))
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if part.path.endswith(".gz") else raw, 1 << 20)
            at = part.start - 1 + len(stream.readline()) if part.start else 0  # the rest of a line that began before
            for number, line in enumerate(stream):
                if part.end is not None and at >= part.end:
                    return
                at += len(line)
                yield line.removesuffix(b"\n").removesuffix(b"\r").decode(), number, part.path, part.start


class TarSource(DataSource):
    """FASTA entries of tar archives, read as a stream: ``value`` (an entry with its ``>``) and ``file_name`` (of the member).
    Options: ``paths`` and ``suffixes``, one per line. An archive cannot be split; one entry at a time is held."""

    @classmethod
    def name(cls) -> str:
        return "lociframe_tar"

    def schema(self) -> str:
        return "value string, file_name string"

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(self.options)


class _TarReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", "").split("\n") if p]
        self.suffixes = tuple(options.get("suffixes", "").split("\n"))

    def partitions(self) -> list[InputPartition]:
        return [_Part(p, 0, None) for p in self.paths]

    def read(self, part: _Part) -> Iterator[tuple]:
        import tarfile

        files, inner = _open(part.path)
        with files.open_input_stream(inner, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as archive:
            for member in archive:
                if not member.isfile() or not member.name.endswith(self.suffixes):
                    continue
                entry: list[str] = []
                for line in archive.extractfile(member):
                    text = line.decode()
                    if text.startswith(">"):
                        if entry:
                            yield "".join(entry), member.name
                        entry = [text]
                    elif entry:  # letters before the first entry are skipped
                        entry.append(text)
                if entry:
                    yield "".join(entry), member.name
