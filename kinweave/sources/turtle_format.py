"""Turtle as a Spark data source: spark.dataSource.register(TurtleSource), then format("turtle").

Reading: files are cut into byte ranges of option splitBytes (32 MB). A range owns the statements that
follow a statement's end (a full stop that ends a line) which lies in it, so no statement is read
twice or lost wherever the cuts fall, and lines are read as a stream. Each range reads the
@prefix lines at the head of its file first, so a file may bind any names to any namespaces; terms
come out under the library's own prefixes where the namespace is known, as <address> otherwise.

Writing: each task writes one file of statement blocks under a name of its own in a folder for this write; the commit
moves the files of the tasks that Spark counts, an abort drops the folder, so retried tasks leave nothing behind.

Files are opened through pyarrow (local paths, hdfs, object stores); turtle.read_turtle() reads whatever Spark reads.

Defined cases: comments and blank lines go; a prefix bound after the first statement, or one that isn't
bound, is an error that names the file; literals don't span lines, as in the language's short form; an empty file has no
triples; rows with a null subject, predicate or object aren't written; other columns aren't either.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .turtle import PREFIXES

SCHEMA = "system string, subj string, pred string, obj string, kind string, datatype string"
SPLIT_BYTES = 32 << 20
_ROWS = 8192
_QUIET = re.compile(r'"(?:[^"\\]|\\.)*"|<[^>]*>|#.*')
_TOKENS = re.compile(r'#[^\n]*|"(?P<text>(?:[^"\\\n]|\\.)*)"(?:\^\^(?P<type><[^>]*>|[^\s;,]+?(?=\.?(?:[\s;,]|$)))|@[A-Za-z-]+)?|<[^>\s]*>|[;,]|\.(?=\s|$)|[^\s;,"<]+?(?=\.?(?:[\s;,]|$))')
_PREFIX = re.compile(r"\s*@prefix\s+(\S*):\s*<([^>]*)>\s*\.\s*$")
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r"}
#: What an address can't hold as it is.
_BARRED = re.compile(r"[\x00-\x20<>\"{}|^`\\]")
_NUMBER = re.compile(r"[-+]?[0-9][0-9.eE+-]*$")
_LOCAL = re.compile(r"[A-Za-z0-9_-]+$")


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda e: chr(int(e[1][1:], 16)) if len(e[1]) > 1 else _PLAIN.get(e[1], e[1]), text) if "\\" in text else text


def _address(text: str) -> str:
    """<text>, with what an address can't hold escaped."""
    return "<" + _BARRED.sub(lambda c: f"\\u{ord(c[0]):04X}", text) + ">"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:/", path) else (fs.LocalFileSystem(), path)


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__((self.path, self.start))


def _ends(line: str) -> bool:
    """Whether a line ends a statement."""
    return "." in line and _QUIET.sub("", line).rstrip().endswith(".")


def _owned(lines: Iterator[tuple[int, str]], start: int, end: int) -> Iterator[str]:
    """The statements of a range, as the lines up to an end each; lines come with their places in the file, from the first that starts in the range on."""
    mine, held = start == 0, []
    for at, line in lines:
        if mine:
            held.append(line)
        elif at >= end:
            return
        if _ends(line):
            if held:
                yield "".join(held)
            mine, held = start <= at < end, []
            if not mine:
                return
    if held and "".join(held).strip():
        yield "".join(held)


class _Names:
    """The prefixes of a file."""

    def __init__(self, path: str, bound: dict[str, str]):
        self.path, self.bound, self.known = path, bound, {}
        self.spaces = {space: prefix for prefix, space in PREFIXES.items()}

    def of(self, token: str) -> str:
        """A term under the library's prefixes."""
        if token not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[token] = self._of(token)
        return self.known[token]

    def _of(self, token: str) -> str:
        if token.startswith("<"):
            address = _unescaped(token[1:-1])
        else:
            prefix, colon, local = token.partition(":")
            if not colon or prefix == "_":
                return token
            if prefix not in self.bound:
                raise ValueError(f"{self.path}: prefix {prefix}: isn't bound at the head of the file")
            address = self.bound[prefix] + local
        for space, prefix in self.spaces.items():
            if address.startswith(space):
                return f"{prefix}:{address[len(space):]}"
        return f"<{address}>"


def _triples(statement: str, names: _Names) -> Iterator[tuple]:
    """(subj, pred, obj, kind, datatype) of the statements in a text."""
    subj = pred = None
    for m in _TOKENS.finditer(statement):
        t = m[0]
        if t[0] == "#" or t == ",":
            continue
        if t == ".":
            subj = pred = None
        elif t == ";":
            pred = None
        elif t.startswith("@prefix"):
            raise ValueError(f"{names.path}: a prefix is bound after the first statement")
        elif subj is None:
            subj = names.of(t)
        elif pred is None:
            pred = names.of(t) if t != "a" else t
        elif t[0] == '"':
            yield subj, pred, _unescaped(m["text"]), "literal", names.of(m["type"]) if m["type"] else None
        elif _NUMBER.match(t):
            yield subj, pred, t, "literal", None
        else:
            yield subj, pred, names.of(t), "iri", None


class TurtleReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[FileRange]:
        store, at = _opened(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not re.search(r"/[._]", f.path[len(at) :])]
        scheme = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        return [FileRange(scheme + f.path, k, min(k + self.split, f.size)) for f in files for k in range(0, f.size, self.split)]

    def _head(self, store: fs.FileSystem, at: str) -> tuple[dict[str, str], int]:
        """The prefixes bound at the head of a file, and where it ends."""
        bound, place = {}, 0
        with store.open_input_stream(at) as f:
            for raw in _lines(f):
                line = raw.decode()
                found = _PREFIX.match(line)
                if found:
                    bound[found[1]] = found[2]
                elif line.strip() and not line.lstrip().startswith("#"):
                    break
                place += len(raw)
        return bound, place

    def read(self, partition: FileRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # which Spark asks for where there are no ranges
            return
        store, at = _opened(partition.path)
        bound, head = self._head(store, at)
        names, system = _Names(partition.path, bound), PurePosixPath(at).stem
        start = partition.start
        with store.open_input_file(at) as f:
            # A range that begins in the middle of a line begins with the next one.
            f.seek(max(0, start - 1))
            lines, place = _lines(f), max(0, start - 1)
            if start:
                place += len(next(lines, b""))

            def placed() -> Iterator[tuple[int, str]]:
                nonlocal place
                for raw in lines:
                    # What the head has said already is read as an end without a statement.
                    yield place, raw.decode() if place >= head or not _ends(raw.decode()) else ".\n"
                    place += len(raw)

            rows: list[tuple] = []
            for statement in _owned(placed(), start, partition.end):
                rows += [(system, *t) for t in _triples(statement, names)]
                if len(rows) >= _ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _lines(f) -> Iterator[bytes]:
    """Lines with their ends, from where f stands."""
    rest = b""
    while block := f.read(1 << 20):
        *whole, rest = (rest + bytes(block)).split(b"\n")
        for line in whole:
            yield line + b"\n"
    if rest:
        yield rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


def _term(name: str) -> str:
    """A name as the file has it: prefixed where its local part is plain, else as an address."""
    prefix, colon, local = name.partition(":")
    if name.startswith("<"):
        return _address(name[1:-1])
    if not colon or prefix not in PREFIXES or _LOCAL.match(local):
        return name
    return _address(PREFIXES[prefix] + local)


def _object(obj: str, kind: str, datatype: str | None) -> str:
    if kind != "literal":
        return _term(obj)
    if datatype is None and re.fullmatch(r"[-+]?[0-9]+", obj):
        return obj
    text = obj.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    return f'"{text}"' + (f"^^{_term(datatype)}" if datatype else "")


class TurtleWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Written:
        store, at = _opened(f"{self.path}/{self.run}")
        store.create_dir(at, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.ttl", None
        try:
            full = (r for r in rows if r["subj"] is not None and r["pred"] is not None and r["obj"] is not None)
            for subj, group in groupby(full, key=lambda r: r["subj"]):
                if out is None:
                    out = store.open_output_stream(f"{at}/{name}")
                    out.write("".join(f"@prefix {p}: <{s}> .\n" for p, s in PREFIXES.items()).encode() + b"\n")
                facts = [f"{'a' if r['pred'] == 'a' else _term(r['pred'])} {_object(r['obj'], r['kind'], r['datatype'])}" for r in group]
                out.write((f"{_term(subj)} " + " ;\n    ".join(facts) + " .\n\n").encode())
        finally:
            if out is not None:
                out.close()
        return _Written(name if out is not None else None)

    def commit(self, messages: list[_Written | None]) -> None:
        store, at = _opened(self.path)
        store.create_dir(at, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
        for m in messages:
            if m is not None and m.name:
                store.move(f"{at}/{self.run}/{m.name}", f"{at}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, at = _opened(f"{self.path}/{self.run}")
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


class TurtleSource(DataSource):
    """format("turtle"): load(path) reads a file or folder; columns system, subj, pred, obj, kind, datatype."""

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TurtleReader:
        return TurtleReader(self.options["path"], int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT_BYTES))))

    def writer(self, schema, overwrite: bool) -> TurtleWriter:
        return TurtleWriter(self.options["path"], overwrite)
