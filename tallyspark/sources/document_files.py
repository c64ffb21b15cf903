"""Documents as JSON files, one file a document, as Python data sources for batches and streams.

``glyph_dump`` holds one JSON array of glyphs a file, ``labelled_statement`` one object with its
transactions. A file is named after its document, percent-encoded, so any identifier comes back as it
was. Tasks write whole documents into folders of their own; the commit moves them to their place and
then adds one entry to the folder's log, so readers see all of a write or nothing, a repeated task or
micro-batch leaves nothing behind, and a stream follows the log entry by entry. A folder without a log
(dumps made elsewhere) is read as the ``.json`` files that lie in it. A document that is written again
replaces the one before. With the option ``compression`` set to gzip its file ends in ``.json.gz``; both
kinds are read. ``document_text`` are the same files, a row a document with the file's bytes.

The driver never holds the documents' names. A task that writes keeps a list of its own, a name a line,
and tells where the list may be cut into the shares of reading tasks; an entry of the log names lists,
and, in one more list, what it wrote again. A task that reads goes through its share of a list. Only the
files of a folder without a log are listed by the driver.

Paths may be of any store that pyarrow's file systems reach: local and shared folders, object stores,
HDFS. One document is in memory at a time, or as many as make a batch of small ones.
"""

from __future__ import annotations

import itertools
import json
import posixpath
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from tallyspark.sources.glyph_json import packed, unpacked

LOG, STAGED, LISTS, ENDING, PACKED = "_log", "_staged", "_lists", ".json", ".json.gz"
#: Bytes of JSON that one task reads; what a packed byte counts where the JSON's size isn't known, and what opening a file does.
TASK_BYTES, PACKED_BYTES, FILE_BYTES = 32 << 20, 12, 1 << 10
#: Names that the driver compares at a time, and documents' rows and bytes that make a batch.
CHECKED, BATCH_ROWS, BATCH_BYTES = 1 << 22, 8192, 8 << 20
_NUMBER = (int, float)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path[5:]
    return fs.LocalFileSystem(), path


def _read(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path, compression=None) as file:
        return file.read()


def _read_text(store: fs.FileSystem, path: str) -> str:
    data = _read(store, path)
    return (unpacked(data) if path.endswith(PACKED) else data).decode()


def _write(store: fs.FileSystem, path: str, data: bytes) -> None:
    with store.open_output_stream(path, compression=None) as file:
        file.write(data)


def file_of(document: str | None, ending: str = ENDING) -> str:
    """The file's name of a document, which must have one."""
    if not document:
        raise ValueError("a document without a name cannot be written")
    return quote(document, safe="").replace(".", "%2E", 1 if document.startswith(".") else 0).replace("_", "%5F", 1 if document.startswith("_") else 0) + ending


def document_of(path: str) -> str:
    """All of a file's name but its ending."""
    return unquote(_stem(posixpath.basename(path)))


def _stem(name: str) -> str:
    return name[: -len(PACKED)] if name.endswith(PACKED) else name.removesuffix(ENDING)


def _other(path: str) -> str:
    """The same document's file of the other kind."""
    return path.removesuffix(PACKED) + ENDING if path.endswith(PACKED) else path.removesuffix(ENDING) + PACKED


@dataclass(frozen=True)
class _Share:
    """The lines of a list between two bytes; entries ``since`` to ``until`` of the log may have written
    some of the documents again."""

    path: str
    start: int
    stop: int
    since: int
    until: int


@dataclass
class _Files(InputPartition):
    """Files that one task reads."""

    paths: tuple[str | _Share, ...]

    def __init__(self, paths: tuple[str | _Share, ...]):
        super().__init__(None)
        self.paths = paths


@dataclass
class _Written(WriterCommitMessage):
    """The documents that a task wrote, and under which staged names; or the list that has their names,
    which is also the folder where they are staged, how many they are, and the list's cuts: where a
    share ends, and its bytes of JSON."""

    files: list[tuple[str, str]]
    list: str | None = None
    number: int = 0
    cuts: Sequence[tuple[int, int]] = field(default_factory=tuple)


class _Folder:
    """A folder of documents and its log."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def entries(self) -> list[str]:
        """The log's entries, oldest first."""
        store, base = _opened(self.path)
        found = store.get_file_info(fs.FileSelector(f"{base}/{LOG}", allow_not_found=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(ENDING))

    def _log(self, start: int = 0, stop: int | None = None) -> list[dict]:
        store, _ = _opened(self.path)
        return [json.loads(_read_text(store, entry)) for entry in self.entries()[start:stop]]

    def _names(self, listed: str, start: int = 0, stop: int | None = None) -> Iterator[str]:
        """The names of a list, or of what lies between two bytes of it."""
        store, base = _opened(self.path)
        if stop is not None:
            with store.open_input_file(f"{base}/{LISTS}/{listed}") as file:
                file.seek(start)
                yield from file.read(stop - start).decode().splitlines()
            return
        rest = b""
        with store.open_input_stream(f"{base}/{LISTS}/{listed}", compression=None) as file:
            while block := file.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from (name.decode() for name in whole)

    def pieces(self, start: int = 0, stop: int | None = None) -> list[tuple[str | _Share, int]]:
        """What some log entries wrote, or the files of a folder without a log, with the bytes of it."""
        if not self.entries():
            return self._listing()
        store, base = _opened(self.path)
        log = self._log(start, stop)
        plain, later = [], set()
        for k in reversed(range(len(log)) if any(e["files"] for e in log) else ()):
            own = [n for n in dict.fromkeys(log[k]["files"]) if _stem(n) not in later]
            plain[:0] = own
            later.update(map(_stem, own))
            if log[k].get("again") and any(e["files"] for e in log[:k]):
                later.update(self._names(log[k]["again"]))
        found = zip(plain, store.get_file_info([f"{base}/{n}" for n in plain]))
        out = [(f.path, _weight(f)) for _, f in found if f.type == fs.FileType.File or store.get_file_info(_other(f.path)).type != fs.FileType.File]
        last = max((k + 1 for k, e in enumerate(log) if e.get("again")), default=0)
        for k, entry in enumerate(log):
            for listed, cuts in entry.get("lists", ()):
                for (begin, _), (end, size) in itertools.pairwise([(0, 0), *cuts]):
                    out.append((_Share(listed, begin, end, start + k + 1, start + max(last, k + 1)), size))
        return out

    def _listing(self) -> list[tuple[str, int]]:
        store, base = _opened(self.path)
        return sorted((f.path, _weight(f)) for f in store.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File and f.path.endswith((ENDING, PACKED)))

    def paths(self, task: _Files) -> Iterator[str]:
        """The files of a task's share, without those of documents that were written again."""
        _, base = _opened(self.path)
        for piece in task.paths:
            if isinstance(piece, str):
                yield piece
                continue
            names = list(self._names(piece.path, piece.start, piece.stop))
            own, again = set(map(_stem, names)), set()
            for entry in self._log(piece.since, piece.until) if piece.since < piece.until else ():
                if entry.get("again"):
                    again.update(n for n in self._names(entry["again"]) if n in own)
            yield from (f"{base}/{n}" for n in names if _stem(n) not in again)

    def read(self, task: _Files) -> Iterator[tuple[str, bytes]]:
        """Paths of a task's files and what they hold."""
        store, _ = _opened(self.path)
        for path in self.paths(task):
            try:
                yield path, _read(store, path)
            except FileNotFoundError:
                # a later write has put the other kind in its place
                if store.get_file_info(_other(path)).type != fs.FileType.File:
                    raise

    def split(self, files: list[tuple[str | _Share, int]]) -> list[_Files]:
        tasks: list[list[str | _Share]] = []
        room = 0
        for path, size in files:
            if not tasks or size > room:
                tasks.append([])
                room = TASK_BYTES
            tasks[-1].append(path)
            room -= size
        return [_Files(tuple(t)) for t in tasks] or [_Files(())]

    def _staged(self, messages: Iterable[_Written]) -> Iterator[tuple[str, str]]:
        """The names of documents' files and where they are staged."""
        _, base = _opened(self.path)
        for message in messages:
            for document, staged in message.files:
                yield file_of(document, PACKED if staged.endswith(PACKED) else ENDING), f"{base}/{STAGED}/{staged}"
            for name in self._names(message.list) if message.list else ():
                yield name, f"{base}/{STAGED}/{message.list}/{name}"

    def _repeated(self, messages: list[_Written]) -> list[str]:
        """Names that come more than once, some of them if they are many."""
        names = lambda: (name for name, _ in self._staged(messages))
        turns = 1 + sum(len(m.files) + m.number for m in messages) // CHECKED
        for turn in range(turns):
            held = np.sort(np.fromiter((h for h in map(hash, names()) if h % turns == turn), np.int64))
            same = set(held[1:][held[1:] == held[:-1]].tolist())
            found = sorted(n for n, k in Counter(n for n in names() if hash(n) in same).items() if k > 1) if same else []
            if found:
                return found
        return []

    def commit(self, messages: list[_Written | None], name: str | None = None, replace: bool = False, fresh: bool = False) -> None:
        """Puts staged documents in their place. ``name``: an entry that is there already is not
        added again. ``replace``: the folder's former documents go. ``fresh``: there was no such folder
        before the write."""
        store, base = _opened(self.path)
        log, told = self.entries(), [m for m in messages if m]
        if name is not None and any(posixpath.basename(e).endswith(f"-{name}{ENDING}") for e in log):
            self.abort(messages)
            return
        if twice := self._repeated(told):
            self.abort(messages)
            raise ValueError(f"rows of one document lay in several tasks or apart from each other: {', '.join(map(document_of, twice[:5]))}")
        if replace and store.get_file_info(base).type == fs.FileType.Directory:
            self._clear(log)
        number = int(posixpath.basename(log[-1]).split("-")[0]) + 1 if log else 0
        again = self._place(told, replace or fresh and not log)
        for message in told:
            if message.list:
                store.delete_dir(f"{base}/{STAGED}/{message.list}")
        store.create_dir(f"{base}/{LOG}")
        entry = {"files": [name for name, _ in self._staged(_Written(m.files) for m in told)], "lists": [[m.list, m.cuts] for m in told if m.list], "again": again}
        _write(store, f"{base}/{LOG}/{number:012d}-{name or uuid.uuid4().hex}{ENDING}", json.dumps(entry).encode())

    def _place(self, messages: list[_Written], alone: bool) -> str | None:
        """Moves documents to their place. Unless none can be there (``alone``), those they replace go,
        and are told in a list."""
        store, base = _opened(self.path)
        if alone:
            for final, staged in self._staged(messages):
                store.move(staged, f"{base}/{final}")
            return None
        listed, out = uuid.uuid4().hex, None
        for final, staged in self._staged(messages):
            for there in store.get_file_info([f"{base}/{final}", _other(f"{base}/{final}")]):
                if there.type != fs.FileType.NotFound:
                    if out is None:
                        store.create_dir(f"{base}/{LISTS}")
                        out = store.open_output_stream(f"{base}/{LISTS}/{listed}", compression=None)
                    out.write(f"{_stem(final)}\n".encode())
                    store.delete_file(there.path)
            store.move(staged, f"{base}/{final}")
        if out is None:
            return None
        out.close()
        return listed

    def _clear(self, log: list[str]) -> None:
        """Deletes the folder's documents, its log and its lists."""
        store, base = _opened(self.path)
        for path, _ in () if log else self._listing():
            store.delete_file(path)
        for entry in self._log():
            lists = [listed for listed, _ in entry.get("lists", ())]
            for name in itertools.chain(entry["files"], *map(self._names, lists)):
                _drop(store, f"{base}/{name}")
            for listed in (*lists, entry.get("again")):
                if listed:
                    store.delete_file(f"{base}/{LISTS}/{listed}")
        for entry in log:
            store.delete_file(entry)

    def abort(self, messages: list[_Written | None]) -> None:
        store, base = _opened(self.path)
        for message in messages:
            for _, staged in message.files if message else ():
                _drop(store, f"{base}/{STAGED}/{staged}")
            if message and message.list:
                self.drop_list(message.list)

    def drop_list(self, listed: str) -> None:
        """Deletes what a task has staged and its list."""
        store, base = _opened(self.path)
        if store.get_file_info(f"{base}/{STAGED}/{listed}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{STAGED}/{listed}")
        _drop(store, f"{base}/{LISTS}/{listed}")


def _weight(file: fs.FileInfo) -> int:
    return (file.size or 0) * (PACKED_BYTES if file.path.endswith(PACKED) else 1)


def _drop(store: fs.FileSystem, path: str) -> None:
    try:
        store.delete_file(path)
    except FileNotFoundError:
        pass


class _Codec:
    """How rows of one document and its JSON become each other; the schema's first column names it."""

    schema: str
    fields: pa.Schema

    def rows(self, document: str, data: object) -> list[tuple]:
        raise NotImplementedError

    def data(self, rows: list[tuple]) -> object:
        raise NotImplementedError


class _Glyphs(_Codec):
    schema = "doc_id string, glyph_ord long, text string, page int, x double, y double, w double, h double"
    fields = pa.schema([("doc_id", pa.string()), ("glyph_ord", pa.int64()), ("text", pa.string()), ("page", pa.int32()), *((c, pa.float64()) for c in "xywh")])

    def rows(self, document: str, data: object) -> list[tuple]:
        if not isinstance(data, list):
            raise ValueError("a glyph dump is an array")
        out = []
        for k, g in enumerate(data):
            if not (isinstance(g, dict) and isinstance(g.get("text"), str) and isinstance(g.get("page"), int) and all(isinstance(g.get(c), _NUMBER) and not isinstance(g.get(c), bool) for c in "xywh")):
                raise ValueError(f"glyph {k} needs a text, a page and the numbers x, y, w and h")
            out.append((document, k, g["text"], g["page"], *(float(g[c]) for c in "xywh")))
        return out

    def data(self, rows: list[tuple]) -> object:
        return [dict(zip(("text", "page", "x", "y", "w", "h"), r[2:])) for r in sorted(rows, key=lambda r: r[1])]


class _Labelled(_Codec):
    """A statement without transactions is one row whose ord is null. Amounts are money as text."""

    schema = "statement_id string, issuer string, glyph_fixture string, ord int, date string, description string, amount string"
    fields = pa.schema([(c, pa.int32() if c == "ord" else pa.string()) for c in ("statement_id", "issuer", "glyph_fixture", "ord", "date", "description", "amount")])
    head, item = ("statement_id", "issuer", "glyph_fixture"), ("date", "description", "amount")

    def rows(self, document: str, data: object) -> list[tuple]:
        if not isinstance(data, dict) or not all(isinstance(data.get(c), str) for c in self.head) or not isinstance(data.get("transactions"), list):
            raise ValueError("a labelled statement needs statement_id, issuer, glyph_fixture and transactions")
        head = tuple(data[c] for c in self.head)
        for k, t in enumerate(data["transactions"]):
            if not isinstance(t, dict) or not all(isinstance(t.get(c), str) for c in self.item):
                raise ValueError(f"transaction {k} needs date, description and amount as text")
        return [(*head, k, *(t[c] for c in self.item)) for k, t in enumerate(data["transactions"])] or [(*head, None, None, None, None)]

    def data(self, rows: list[tuple]) -> object:
        heads = {r[:3] for r in rows}
        if len(heads) > 1 or None in next(iter(heads)):
            raise ValueError(f"the rows of statement {rows[0][0]} need one issuer and one glyph fixture")
        own = sorted((r for r in rows if r[3] is not None), key=lambda r: r[3])
        return dict(zip(self.head, next(iter(heads)))) | {"transactions": [dict(zip(self.item, r[4:])) for r in own]}


class _Texts(_Codec):
    """A row a document: its file's bytes and, of what is written, how much JSON that is."""

    schema = "doc_id string, path string, size long, content binary"
    fields = pa.schema([("doc_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


def _rows(codec: _Codec, path: str, text: bytes) -> list[tuple]:
    try:
        return codec.rows(document_of(path), json.loads(text.decode()))
    except ValueError as error:
        raise ValueError(f"{path}: {error}") from error


def glyph_rows(path: str, text: bytes) -> list[tuple]:
    """A dump's glyphs as ``glyph_dump`` reads them."""
    return _rows(_Glyphs(), path, text)


class _Reads:
    """What batch and stream readers do in a task."""

    codec: _Codec
    folder: _Folder

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for path, data in self.folder.read(partition):
            rows += self.rows(path, data)
            size += len(data)
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def rows(self, path: str, data: bytes) -> list[tuple]:
        if isinstance(self.codec, _Texts):
            return [(document_of(path), path, len(data), data)]
        return _rows(self.codec, path, unpacked(data) if path.endswith(PACKED) else data)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.codec.fields)], schema=self.codec.fields)


class _BatchReader(_Reads, DataSourceReader):
    def __init__(self, codec: _Codec, folder: _Folder):
        self.codec, self.folder = codec, folder

    def partitions(self) -> list[_Files]:
        return self.folder.split(self.folder.pieces())


class _StreamReader(_Reads, DataSourceStreamReader):
    """An offset is a number of log entries."""

    def __init__(self, codec: _Codec, folder: _Folder):
        self.codec, self.folder = codec, folder

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        return {"entries": len(self.folder.entries())}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        if start["entries"] == end["entries"]:
            return [_Files(())]
        return self.folder.split(self.folder.pieces(start["entries"], end["entries"]))


class _Writes:
    """What batch and stream writers do in a task: each document's rows, which follow one another,
    become one staged file."""

    codec: _Codec
    folder: _Folder
    ending: str

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, base = _opened(self.folder.path)
        documents = self.documents(batches)
        first = next(documents, None)
        if first is None:
            return _Written([])
        listed = uuid.uuid4().hex
        staged, number, at, size, cuts = f"{base}/{STAGED}/{listed}", 0, 0, 0, []
        try:
            for folder in (staged, f"{base}/{LISTS}"):
                store.create_dir(folder)
            with store.open_output_stream(f"{base}/{LISTS}/{listed}", compression=None, buffer_size=1 << 16) as names:
                for document, data, weight in itertools.chain([first], documents):
                    name = file_of(document, self.ending)
                    _write(store, f"{staged}/{name}", data)
                    line = f"{name}\n".encode()
                    names.write(line)
                    number, at, size = number + 1, at + len(line), size + weight + FILE_BYTES
                    if size >= TASK_BYTES:
                        cuts.append((at, size))
                        size = 0
        except BaseException:
            self.folder.drop_list(listed)
            raise
        return _Written([], listed, number, [*cuts, (at, size)] if size else cuts)

    def documents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes, int]]:
        """Each document, its file's bytes and how much JSON that is."""
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in self.codec.fields.names)))
        if isinstance(self.codec, _Texts):
            yield from ((document, content, size) for document, _, size, content in rows)
            return
        for document, own in itertools.groupby(rows, key=lambda r: r[0]):
            file_of(document)
            data = json.dumps(self.codec.data(list(own)), ensure_ascii=False, indent=2 if self.ending == ENDING else None, allow_nan=False).encode()
            yield document, packed(data) if self.ending == PACKED else data, len(data)

    def abort(self, messages: list, *_: int) -> None:
        self.folder.abort(messages)


class _BatchWriter(_Writes, DataSourceArrowWriter):
    def __init__(self, codec: _Codec, folder: _Folder, ending: str, overwrite: bool):
        self.codec, self.folder, self.ending, self.overwrite = codec, folder, ending, overwrite
        store, base = _opened(folder.path)
        self.fresh = store.get_file_info(base).type == fs.FileType.NotFound

    def commit(self, messages: list) -> None:
        self.folder.commit(messages, replace=self.overwrite, fresh=self.fresh)


class _StreamWriter(_Writes, DataSourceStreamArrowWriter):
    def __init__(self, codec: _Codec, folder: _Folder, ending: str, query: str):
        self.codec, self.folder, self.ending, self.query = codec, folder, ending, query

    def commit(self, messages: list, batchId: int) -> None:
        self.folder.commit(messages, name=f"{self.query}.{batchId}")


class _DocumentFiles(DataSource):
    codec: _Codec

    def schema(self) -> str:
        return self.codec.schema

    def _folder(self) -> _Folder:
        if not self.options.get("path"):
            raise ValueError(f"{self.name()} needs a path")
        return _Folder(self.options["path"])

    def _ending(self) -> str:
        kind = self.options.get("compression", "none").lower()
        if kind not in ("none", "gzip"):
            raise ValueError(f"{self.name()} is written with compression none or gzip, not {kind}")
        return PACKED if kind == "gzip" else ENDING

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.codec, self._folder())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.codec, self._folder())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _BatchWriter(self.codec, self._folder(), self._ending(), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.codec, self._folder(), self._ending(), self.options.get("query", "stream"))


class GlyphDumps(_DocumentFiles):
    codec = _Glyphs()

    @classmethod
    def name(cls) -> str:
        return "glyph_dump"


class DocumentTexts(_DocumentFiles):
    codec = _Texts()

    @classmethod
    def name(cls) -> str:
        return "document_text"


class LabelledStatements(_DocumentFiles):
    codec = _Labelled()

    @classmethod
    def name(cls) -> str:
        return "labelled_statement"
