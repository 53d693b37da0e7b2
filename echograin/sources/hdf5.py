"""HDF5 files as tables, from the public file format alone.

Reading takes three steps, each a table: the objects of every file (groups and
data sets with their attributes), the pieces of its data sets (a chunk each, or
a run of rows of data that lies in one stretch), and the cells of the pieces.
A file's headers and chunk indexes are walked in one task by small reads; its
pieces are dealt over tasks, which read and inflate their own ranges of bytes.

Read are superblocks 0 to 3, both kinds of object headers, groups by symbol
tables or link messages, whole numbers, floating point, fixed and variable
strings, enumerations and complex pairs, compact, contiguous and chunked data
(version 1 trees; single, implicit and fixed-array indexes), and the deflate,
shuffle and checksum filters.  What else there is raises NotImplementedError
with its name.  hdf5_bytes() writes the plain form: symbol tables, version 1
trees, deflated chunks.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import Content, File, list_files
from .readers import CELLS, cell_batch

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
#: Bytes of contiguous data that one piece covers.
PIECE_BYTES = 4 << 20
#: Message types of object headers, fixed by the format.
_SPACE, _LINK_INFO, _TYPE, _LINK, _LAYOUT, _FILTERS, _ATTRIBUTE, _CONTINUED, _SYMBOLS, _ATTRIBUTE_INFO = 0x01, 0x02, 0x03, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11, 0x15
#: Filter numbers, fixed by the format.
_DEFLATE, _SHUFFLE, _CHECKSUM = 1, 2, 3


@dataclass
class Dataset:
    """A data set's place and kind."""

    name: str
    shape: tuple[int, ...]
    kind: str  #: a numpy type string; "vlen" for strings of variable length
    chunks: tuple[int, ...] | None
    filters: list[tuple[int, list[int]]]
    layout: tuple
    attributes: dict = field(default_factory=dict)


class Walker:
    """The objects of one file."""

    def __init__(self, source: Content | File):
        self.source = source
        head = source.read(0, 128)
        if head[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        version = head[8]
        if version < 2:
            if head[13] != 8 or head[14] != 8:
                raise NotImplementedError("HDF5 files with offsets of other than 8 bytes")
            at = 24 + 4 * (version == 1)
            self.base = struct.unpack_from("<Q", head, at)[0]
            self.root = struct.unpack_from("<Q", head, at + 32 + 8)[0]
        else:
            if head[9] != 8 or head[10] != 8:
                raise NotImplementedError("HDF5 files with offsets of other than 8 bytes")
            self.base, _, _, self.root = struct.unpack_from("<4Q", head, 12)

    def _read(self, at: int, size: int) -> bytes:
        out = self.source.read(self.base + at, size)
        if len(out) < size:
            raise ValueError("an HDF5 file that ends too early")
        return out

    # object headers

    def messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(type, body) of the header messages of an object."""
        if self._read(at, 4) == b"OHDR":
            flags = self._read(at + 5, 1)[0]
            begin = at + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self._read(begin, width), "little")
            todo, tracked = [(begin + width, size)], bool(flags & 4)
            while todo:
                start, size = todo.pop(0)
                block, k = self._read(start, size), 0
                while k + 4 + 2 * tracked <= len(block):
                    kind, length = block[k], struct.unpack_from("<H", block, k + 1)[0]
                    k += 4 + 2 * tracked
                    body = block[k : k + length]
                    k += length
                    if kind == _CONTINUED:
                        where, n = struct.unpack_from("<QQ", body)
                        todo.append((where + 4, n - 8))  # between its signature and its checksum
                    else:
                        yield kind, body
            return
        _, _, count, _, size = struct.unpack("<BBHII", self._read(at, 12))
        todo, seen = [(at + 16, size)], 0
        while todo and seen < count:
            start, size = todo.pop(0)
            block, k = self._read(start, size), 0
            while k + 8 <= len(block) and seen < count:
                kind, length = struct.unpack_from("<HH", block, k)
                body = block[k + 8 : k + 8 + length]
                k += 8 + length
                seen += 1
                if kind == _CONTINUED:
                    todo.append(struct.unpack_from("<QQ", body))
                else:
                    yield kind, body

    # groups

    def links(self, found: list[tuple[int, bytes]]) -> Iterator[tuple[str, int]]:
        """(name, address) of the hard links of a group's messages."""
        for kind, body in found:
            if kind == _SYMBOLS:
                tree, heap = struct.unpack_from("<QQ", body)
                if self._read(heap, 4) != b"HEAP":
                    raise ValueError("a broken local heap")
                size, _, names_at = struct.unpack("<QQQ", self._read(heap + 8, 24))
                yield from self._symbols(tree, self._read(names_at, size))
            elif kind == _LINK:
                flags, k = body[1], 2
                hard = not flags & 8 or body[k] == 0
                k += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                width = 1 << (flags & 3)
                n = int.from_bytes(body[k : k + width], "little")
                k += width
                if hard:
                    yield body[k : k + n].decode(), struct.unpack_from("<Q", body, k + n)[0]
            elif kind == _LINK_INFO and struct.unpack_from("<Q", body, 2 + 8 * (body[1] & 1))[0] != NOWHERE:
                raise NotImplementedError("HDF5 groups whose links lie in a fractal heap")

    def _symbols(self, at: int, names: bytes) -> Iterator[tuple[str, int]]:
        node = self._read(at, 8)
        if node[:4] == b"TREE":
            used = struct.unpack_from("<H", node, 6)[0]
            body = self._read(at + 24, 16 * used + 8)
            for k in range(used):
                yield from self._symbols(struct.unpack_from("<Q", body, 16 * k + 8)[0], names)
        elif node[:4] == b"SNOD":
            used = struct.unpack_from("<H", node, 6)[0]
            body = self._read(at + 8, 40 * used)
            for k in range(used):
                name, where, cached = struct.unpack_from("<QQI", body, 40 * k)
                if cached != 2:  # 2 is a soft link
                    yield names[name : names.index(b"\0", name)].decode(), where
        else:
            raise ValueError("a broken group tree")

    # types, spaces, attributes

    def datatype(self, body: bytes) -> tuple[str, int]:
        """(numpy type string, bytes of its description)."""
        kind, version, bits, size = body[0] & 15, body[0] >> 4, body[1], struct.unpack_from("<I", body, 4)[0]
        order = ">" if bits & 1 else "<"
        if kind == 0:
            return f"{order}{'i' if bits & 8 else 'u'}{size}", 12
        if kind == 1:
            return f"{order}f{size}", 20
        if kind == 3:
            return f"|S{size}", 8
        if kind == 8:  # an enumeration reads as its numbers
            base, n = self.datatype(body[8:])
            return base, 8 + n
        if kind == 9 and bits & 15 == 1:
            return "vlen", 8 + self.datatype(body[8:])[1]
        if kind == 7:
            return f"<u{size}", 8
        if kind == 6:
            members, at = [], 8
            for _ in range(struct.unpack_from("<H", body, 1)[0]):
                end = body.index(b"\0", at)
                name = body[at:end].decode()
                at = end + 1 if version >= 3 else at + -(-(end + 1 - at) // 8) * 8
                if version >= 3:
                    width = next(w for w in (1, 2, 3, 4) if size < 1 << 8 * w)
                    offset, at = int.from_bytes(body[at : at + width], "little"), at + width
                else:
                    offset, at = struct.unpack_from("<I", body, at)[0], at + (32 if version == 1 else 4)
                inner, n = self.datatype(body[at:])
                members.append((name, offset, inner))
                at += n
            if len(members) == 2 and members[0][2][1] == members[1][2][1] == "f" and [m[1] for m in members] == [0, size // 2] and members[0][2] == members[1][2]:
                return f"{members[0][2][0]}c{size}", at
            return json.dumps({"names": [m[0] for m in members], "offsets": [m[1] for m in members], "formats": [m[2] for m in members], "itemsize": size}), at
        raise NotImplementedError(f"HDF5 type class {kind}")

    @staticmethod
    def dataspace(body: bytes) -> tuple[int, ...] | None:
        """The extent; None of a null space."""
        version, rank = body[0], body[1]
        if version == 2 and body[3] == 2:
            return None
        return struct.unpack_from(f"<{rank}Q", body, 8 if version == 1 else 4)

    def _heap_object(self, raw: bytes) -> str:
        """A string of variable length by its (length, collection, index)."""
        n, at, index = struct.unpack("<IQI", raw)
        if not n or at in (0, NOWHERE):
            return ""
        size = struct.unpack("<Q", self._read(at + 8, 8))[0]
        block, k = self._read(at, size), 16
        while k + 16 <= size:
            number, _, _, length = struct.unpack_from("<HHIQ", block, k)
            if number == index:
                return block[k + 16 : k + 16 + n].decode("utf-8", "replace")
            if not number:
                break
            k += 16 + -(-length // 8) * 8
        raise ValueError("a broken global heap")

    def values(self, kind: str, shape: tuple[int, ...], raw: bytes):
        """Plain Python values of raw data: a scalar, or nested lists."""
        n = int(np.prod(shape, dtype=np.int64))
        if kind == "vlen":
            out = np.array([self._heap_object(raw[16 * k : 16 * k + 16]) for k in range(n)], object).reshape(shape)
        elif kind.startswith("{"):
            out = np.frombuffer(raw, np.dtype(json.loads(kind)), n).reshape(shape)
        else:
            out = np.frombuffer(raw, kind, n).reshape(shape)
            if kind[1] == "S":
                out = np.char.decode(out, "utf-8", "replace")
        return out.item() if not shape else out.tolist()

    def attribute(self, body: bytes) -> tuple[str, object]:
        version = body[0]
        name_n, type_n, space_n = struct.unpack_from("<HHH", body, 2)
        at = 8 + (version == 3)
        pad = (lambda n: -(-n // 8) * 8) if version == 1 else (lambda n: n)
        name = body[at : at + name_n].split(b"\0")[0].decode()
        at += pad(name_n)
        kind, _ = self.datatype(body[at : at + type_n])
        at += pad(type_n)
        shape = self.dataspace(body[at : at + space_n])
        at += pad(space_n)
        return name, None if shape is None else self.values(kind, shape, body[at:])

    # objects

    def objects(self) -> Iterator[tuple[str, dict, Dataset | None]]:
        """(name, attributes, data set or None) of all objects, the root ('') first, each once."""
        todo, seen = [("", self.root)], set()
        while todo:
            name, at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            found = list(self.messages(at))
            attributes = {}
            for kind, body in found:
                if kind == _ATTRIBUTE:
                    key, value = self.attribute(body)
                    attributes[key] = value
                elif kind == _ATTRIBUTE_INFO and struct.unpack_from("<Q", body, 2 + 2 * (body[1] & 1))[0] != NOWHERE:
                    raise NotImplementedError("HDF5 attributes that lie in a fractal heap")
            by_kind = dict(found)
            dataset = None
            if _LAYOUT in by_kind and _TYPE in by_kind:
                shape = self.dataspace(by_kind[_SPACE])
                kind, _ = self.datatype(by_kind[_TYPE])
                chunks, layout = self._layout(by_kind[_LAYOUT], () if shape is None else shape, kind)
                dataset = Dataset(name, (0,) if shape is None else shape, kind, chunks, self._filters(by_kind.get(_FILTERS)), layout, attributes)
            yield name, attributes, dataset
            todo += [(f"{name}/{key}" if name else key, where) for key, where in self.links(found)]

    @staticmethod
    def _filters(body: bytes | None) -> list[tuple[int, list[int]]]:
        if body is None:
            return []
        out, at = [], 8 if body[0] == 1 else 2
        for _ in range(body[1]):
            if body[0] == 1:
                number, name_n, _, n = struct.unpack_from("<HHHH", body, at)
                at += 8 + -(-name_n // 8) * 8
            else:
                number = struct.unpack_from("<H", body, at)[0]
                name_n = struct.unpack_from("<H", body, at + 2)[0] if number >= 256 else 0
                at += 4 if number >= 256 else 2
                n = struct.unpack_from("<H", body, at + 2)[0]
                at += 4 + name_n
            out.append((number, list(struct.unpack_from(f"<{n}I", body, at))))
            at += 4 * n + (4 if body[0] == 1 and n % 2 else 0)
        return out

    def _layout(self, body: bytes, shape: tuple[int, ...], kind: str) -> tuple[tuple[int, ...] | None, tuple]:
        """(chunk shape, what pieces() needs)."""
        version, form = body[0], body[1]
        if version not in (3, 4):
            raise NotImplementedError(f"HDF5 layouts of version {version}")
        if form == 0:
            n = struct.unpack_from("<H", body, 2)[0]
            return None, ("inline", body[4 : 4 + n])
        if form == 1:
            return None, ("stretch", *struct.unpack_from("<QQ", body, 2))
        if form != 2:
            raise NotImplementedError("virtual HDF5 data sets")
        if version == 3:
            rank = body[2] - 1
            return struct.unpack_from(f"<{rank}I", body, 11), ("tree", struct.unpack_from("<Q", body, 3)[0])
        flags, rank, width = body[2], body[3] - 1, body[4]
        chunks = tuple(int.from_bytes(body[5 + k * width : 5 + (k + 1) * width], "little") for k in range(rank))
        at = 5 + (rank + 1) * width
        index = body[at]
        if index == 1:
            size, mask = struct.unpack_from("<QI", body, at + 1) if flags & 2 else (None, 0)
            return chunks, ("single", struct.unpack_from("<Q", body, at + (13 if flags & 2 else 1))[0], size, mask)
        if index == 2:
            return chunks, ("implicit", struct.unpack_from("<Q", body, at + 1)[0])
        if index == 3:
            return chunks, ("array", struct.unpack_from("<Q", body, at + 2)[0])
        raise NotImplementedError(f"HDF5 chunk index {index}")

    # pieces of data

    def pieces(self, d: Dataset) -> Iterator[tuple[tuple[int, ...], tuple[int, ...], int, int, int, bytes | None]]:
        """(first cell, shape, address, bytes, mask of filters left out, inline bytes) of the stored pieces of a data set."""
        form = d.layout[0]
        size = 16 if d.kind == "vlen" else _dtype(d.kind).itemsize
        if not all(d.shape):
            return
        if form == "inline":
            yield (0,) * len(d.shape), d.shape, 0, len(d.layout[1]), 0, d.layout[1]
        elif form == "stretch":
            at = d.layout[1]
            if at == NOWHERE:
                return
            line = size * int(np.prod(d.shape[1:], dtype=np.int64))
            n = d.shape[0] if d.shape else 1
            step = max(1, PIECE_BYTES // max(1, line))
            for k in range(0, n, step):
                rows = min(step, n - k)
                yield (k, *(0,) * (len(d.shape) - 1))[: len(d.shape)], (rows, *d.shape[1:])[: len(d.shape)], self.base + at + k * line, rows * line, 0, None
        else:
            whole = size * int(np.prod(d.chunks, dtype=np.int64))
            counts = [-(-n // c) for n, c in zip(d.shape, d.chunks, strict=True)]
            place = lambda k: tuple(int(i) * c for i, c in zip(np.unravel_index(k, counts), d.chunks, strict=True))
            if form == "tree":
                found = self._chunks(d.layout[1], len(d.shape)) if d.layout[1] != NOWHERE else ()
            elif form == "single":
                found = [((0,) * len(d.shape), d.layout[1], whole if d.layout[2] is None else d.layout[2], d.layout[3])]
            elif form == "implicit":
                found = ((place(k), d.layout[1] + k * whole, whole, 0) for k in range(int(np.prod(counts)))) if d.layout[1] != NOWHERE else ()
            else:
                found = ((place(k), *x) for k, x in enumerate(self._array(d.layout[1], whole)))
            for first, at, n, mask in found:
                if at != NOWHERE and all(a < b for a, b in zip(first, d.shape, strict=True)):
                    yield first, d.chunks, self.base + at, n, mask, None

    def _chunks(self, at: int, rank: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """Chunks of a version 1 tree."""
        head = self._read(at, 24)
        if head[:4] != b"TREE" or head[4] != 1:
            raise ValueError("a broken chunk tree")
        level, used = head[5], struct.unpack_from("<H", head, 6)[0]
        key = 8 + 8 * (rank + 1)
        body = self._read(at + 24, used * (key + 8))
        for k in range(used):
            start = k * (key + 8)
            where = struct.unpack_from("<Q", body, start + key)[0]
            if level:
                yield from self._chunks(where, rank)
            else:
                n, mask = struct.unpack_from("<II", body, start)
                yield struct.unpack_from(f"<{rank}Q", body, start + 8), where, n, mask

    def _array(self, at: int, whole: int) -> Iterator[tuple[int, int, int]]:
        """(address, bytes, mask) of a fixed array of chunks."""
        head = self._read(at, 24)
        if head[:4] != b"FAHD":
            raise ValueError("a broken fixed array")
        entry, page_bits, n = head[6], head[7], struct.unpack_from("<Q", head, 8)[0]
        block = struct.unpack_from("<Q", head, 16)[0]
        if block == NOWHERE:
            return
        per_page, at = 1 << page_bits, block + 14
        paged = n > per_page
        if paged:
            pages = -(-n // per_page)
            filled = self._read(at, -(-pages // 8))
            at += len(filled) + 4
        for first in range(0, n, per_page) if paged else [0]:
            some = min(per_page, n - first) if paged else n
            page = first // per_page
            there = not paged or filled[page // 8] & (0x80 >> page % 8)
            body = self._read(at, some * entry) if there else None
            for k in range(some):
                if body is None:
                    yield NOWHERE, 0, 0
                    continue
                e = body[k * entry : (k + 1) * entry]
                where = struct.unpack_from("<Q", e)[0]
                yield (where, int.from_bytes(e[8:-4], "little"), struct.unpack_from("<I", e, entry - 4)[0]) if entry > 8 else (where, whole, 0)
            at += some * entry + 4 * paged


def _dtype(kind: str) -> np.dtype:
    return np.dtype(json.loads(kind)) if kind.startswith("{") else np.dtype(kind)


def unfiltered(raw: bytes, filters: list, mask: int, item: int) -> bytes:
    """The bytes of a chunk before its filters, the last one undone first."""
    for k in range(len(filters) - 1, -1, -1):
        number, values = filters[k]
        if mask >> k & 1:
            continue
        if number == _DEFLATE:
            raw = zlib.decompress(raw)
        elif number == _SHUFFLE:
            n = values[0] if values else item
            whole = len(raw) // n * n
            raw = np.frombuffer(raw[:whole], np.uint8).reshape(n, -1).T.tobytes() + raw[whole:]
        elif number == _CHECKSUM:
            raw = raw[:-4]
        else:
            raise NotImplementedError(f"HDF5 filter {number}")
    return raw


# tables

_OBJECTS = "path string, name string, kind string, shape array<long>, chunks array<long>, type string, attributes map<string, string>"
_PIECES = "path string, name string, type string, shape array<long>, filters string, first array<long>, extent array<long>, at long, size long, mask int, inline binary"


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, complex):
        return str(value)
    return json.dumps(value, default=str)


def _sources(files: pd.DataFrame) -> Iterator[tuple[str, Content | File]]:
    for row in files.itertuples():
        yield row.path, Content(row.content) if "content" in files.columns else File(row.path)


def _files(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    if whole:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return list_files(spark, path).select("path")


def objects_of(files: DataFrame) -> DataFrame:
    """(path, name, kind, shape, chunks, type, attributes) of all groups and data sets of files (path[, content]);
    attributes that aren't text are JSON."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, source in _sources(files):
                rows = []
                for name, attributes, d in Walker(source).objects():
                    about = {k: _text(v) for k, v in attributes.items()}
                    rows.append((path, name, "group" if d is None else "dataset", None if d is None else list(d.shape), list(d.chunks) if d and d.chunks else None, d and d.kind, about))
                yield pd.DataFrame(rows, columns=["path", "name", "kind", "shape", "chunks", "type", "attributes"])

    return files.mapInPandas(walk, _OBJECTS)


def pieces_of(files: DataFrame, like: str = "") -> DataFrame:
    """The pieces of the numeric data sets of files (path[, content]) whose name contains ``like``."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "name", "type", "shape", "filters", "first", "extent", "at", "size", "mask", "inline"]
        for files in batches:
            for path, source in _sources(files):
                walker, rows = Walker(source), []
                for name, _, d in walker.objects():
                    if d is None or like not in name or d.kind == "vlen" or d.kind.startswith("{") or d.kind[1] == "S":
                        continue
                    for first, extent, at, n, mask, inline in walker.pieces(d):
                        if inline is None and isinstance(source, Content):
                            inline = source.read(at, n)
                        rows.append((path, name, d.kind, list(d.shape), json.dumps(d.filters), list(first), list(extent), at, n, mask, inline))
                        if len(rows) >= (64 if isinstance(source, Content) else 10_000):
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(walk, _PIECES)


def texts_of(files: DataFrame, like: str = "") -> DataFrame:
    """(path, name, value) of the single strings of files (path[, content]) whose data set's name contains ``like``."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, source in _sources(files):
                walker, rows = Walker(source), []
                for name, _, d in walker.objects():
                    if d is None or like not in name or int(np.prod(d.shape)) != 1 or not (d.kind == "vlen" or d.kind[1] == "S"):
                        continue
                    for _, _, at, n, mask, inline in walker.pieces(d):
                        raw = unfiltered(source.read(at, n) if inline is None else inline, d.filters, mask, 1)
                        rows.append((path, name, walker.values(d.kind, (), raw)))
                yield pd.DataFrame(rows, columns=["path", "name", "value"])

    return files.mapInPandas(walk, "path string, name string, value string")


def read_h5_texts(spark: SparkSession, path: str, like: str = "", whole: bool = False) -> DataFrame:
    """Single strings of HDF5 files, such as the bounding polygon of NISAR products."""
    return texts_of(_files(spark, path, whole), like)


def piece_values(kind: str, filters: str, mask: int, extent, raw: bytes) -> np.ndarray:
    """The array of one piece."""
    raw = unfiltered(raw, json.loads(filters), mask, np.dtype(kind).itemsize)
    extent = tuple(int(x) for x in extent)
    return np.frombuffer(raw, kind, int(np.prod(extent, dtype=np.int64))).reshape(extent)


def cells_of(pieces: DataFrame, component: str = "real") -> DataFrame:
    """(path, band, row, col, value) of pieces: the last dimension is the column, those before it are counted on as rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, File] = {}
        for batch in batches:
            for p in batch.to_pylist():
                raw = p["inline"]
                if raw is None:
                    if p["path"] not in opened:
                        for f in opened.values():
                            f.close()
                        opened = {p["path"]: File(p["path"])}
                    raw = opened[p["path"]].read(p["at"], p["size"])
                a = piece_values(p["type"], p["filters"], p["mask"], p["extent"], raw)
                shape, first = p["shape"] or [1], p["first"] or [0]
                a = getattr(a.reshape(a.shape or (1,)), component)
                a = a[tuple(slice(0, n - f) for n, f in zip(shape, first, strict=True))]
                at = np.indices(a.shape)
                row = np.zeros(a.shape, np.int64)
                for k in range(len(shape) - 1):
                    row = row * shape[k] + at[k] + first[k]
                yield cell_batch(p["path"], p["name"], row.ravel(), (at[-1] + first[-1]).ravel(), a.ravel())

    return pieces.mapInArrow(read, CELLS)


def read_h5(spark: SparkSession, path: str, like: str = "", component: str = "real", whole: bool = False) -> DataFrame:
    """Cells of the numeric data sets of HDF5 files; ``whole`` reads files through Spark, for stores that only Spark reads."""
    pieces = pieces_of(_files(spark, path, whole), like)
    return cells_of(pieces if whole else pieces.repartition("path", "name", "first"), component)


def read_h5_objects(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Groups, data sets and attributes of HDF5 files."""
    return objects_of(_files(spark, path, whole))


# NISAR products

#: Polarisations in their sorted order and the place of the grids, fixed by the products.
NISAR_POLS = ("HH", "HV", "VH", "VV")


def nisar_grid(frequency: str = "frequencyA") -> str:
    return f"science/LSAR/GSLC/grids/{frequency}"


def nisar_metadata(objects: DataFrame, cells: DataFrame, frequency: str = "frequencyA") -> DataFrame:
    """(path, frequency, polarizations, height, width, epsg, x_min, x_max, y_min, y_max, x_spacing, y_spacing) of products
    that have a polarisation: extent from the coordinates, spacing from their extremes, 0 for one cell; without
    coordinates 0, the shape, and 1.  objects and cells are those of the files."""
    grid = nisar_grid(frequency)
    pol = objects.where(F.col("name").isin([f"{grid}/{p}" for p in NISAR_POLS]))
    pol = pol.groupBy("path").agg(F.sort_array(F.collect_set(F.element_at(F.split("name", "/"), -1))).alias("polarizations"), F.min_by("shape", "name").alias("shape"))
    axis = lambda name, what: F.when(F.col("band") == f"{grid}/{name}", what)
    value, exact = F.col("value").cast("double"), {}
    for name, short in (("xCoordinates", "x"), ("yCoordinates", "y")):
        exact[f"{short}_min"], exact[f"{short}_max"] = F.min(axis(name, value)), F.max(axis(name, value))
    seen = cells.where(F.col("band").isin([f"{grid}/{n}" for n in ("xCoordinates", "yCoordinates", "projection")]))
    seen = seen.groupBy("path").agg(*[v.alias(k) for k, v in exact.items()], F.max(axis("projection", F.col("value"))).cast("int").alias("epsg_value"))
    named = objects.where(F.col("name") == f"{grid}/projection").select("path", F.coalesce(*[F.expr(f"try_cast(attributes['{k}'] AS int)") for k in ("epsg_code", "epsg")]).alias("epsg_named"))
    out = pol.join(seen, "path", "left").join(named, "path", "left")
    height, width = F.col("shape")[0], F.col("shape")[1]
    both = F.col("x_min").isNotNull() & F.col("y_min").isNotNull()
    spacing = lambda a, n: F.when(~both, 1.0).when(n > 1, (F.col(f"{a}_max") - F.col(f"{a}_min")) / (n - 1)).otherwise(0.0)
    edge = lambda c, other: F.when(both, F.col(c)).otherwise(other).alias(c)
    return out.select(
        "path", F.lit(frequency).alias("frequency"), "polarizations", height.alias("height"), width.alias("width"), F.coalesce("epsg_value", "epsg_named").alias("epsg"),
        edge("x_min", F.lit(0.0)), edge("x_max", width.cast("double")), edge("y_min", F.lit(0.0)), edge("y_max", height.cast("double")), spacing("x", width).alias("x_spacing"), spacing("y", height).alias("y_spacing"),
    )


def read_nisar(spark: SparkSession, path: str, pols: list[str], frequency: str = "frequencyA", component: str = "real", whole: bool = False) -> DataFrame:
    """Cells (path, band, row, col, value) of polarisations of NISAR products; the band is the polarisation.  Names are
    trimmed and upper-cased; none, or an empty one, is an error."""
    wanted = [p.strip().upper() for p in pols]
    if not wanted or "" in wanted:
        raise ValueError("polarisations have to be names that aren't empty")
    files = _files(spark, path, whole)
    pieces = pieces_of(files, f"{nisar_grid(frequency)}/").where(F.element_at(F.split("name", "/"), -1).isin(wanted))
    cells = cells_of(pieces if whole else pieces.repartition("path", "name", "first"), component)
    return cells.withColumn("band", F.element_at(F.split("band", "/"), -1))


# writing


class _Writer:
    """Lays out the parts of a file; every part is placed once and its address is known from then on."""

    LEAF, CHILDREN = 4, 32

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.at = 96  # after the superblock

    def put(self, data: bytes) -> int:
        data += b"\0" * (-len(data) % 8)
        at, self.at = self.at, self.at + len(data)
        self.parts.append(data)
        return at

    @staticmethod
    def datatype(kind: np.dtype) -> bytes:
        bits = 1 if kind.byteorder == ">" else 0
        if kind.kind in "iu":
            return struct.pack("<BBBBIHH", 0x10, bits | (8 if kind.kind == "i" else 0), 0, 0, kind.itemsize, 0, 8 * kind.itemsize)
        if kind.kind == "f":
            #: sign place, exponent place and bits, mantissa bits, bias, fixed by IEEE 754
            sign, place, e, m, bias = {2: (15, 10, 5, 10, 15), 4: (31, 23, 8, 23, 127), 8: (63, 52, 11, 52, 1023)}[kind.itemsize]
            return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20 | bits, sign, 0, kind.itemsize, 0, 8 * kind.itemsize, place, e, 0, m, bias)
        if kind.kind == "S":
            return struct.pack("<BBBBI", 0x13, 0, 0, 0, kind.itemsize)
        if kind.kind == "c":
            half = np.dtype(f"{kind.byteorder if kind.byteorder in '<>' else '<'}f{kind.itemsize // 2}")
            member = lambda name, at: name.ljust(8, b"\0") + struct.pack("<IB3xII16x", at, 0, 0, 0) + _Writer.datatype(half)
            return struct.pack("<BBBBI", 0x16, 2, 0, 0, kind.itemsize) + member(b"r", 0) + member(b"i", half.itemsize)
        raise NotImplementedError(f"no HDF5 type for {kind}")

    @staticmethod
    def dataspace(shape: tuple[int, ...]) -> bytes:
        return struct.pack("<BBB5x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)

    def attribute(self, name: str, value) -> bytes:
        if isinstance(value, str):
            value = np.array(value.encode() or b"\0")
        a = np.asarray(value)
        if a.dtype.kind == "b":
            a = a.astype("i1")
        if a.dtype.kind == "U":
            a = np.char.encode(a, "utf-8")
        kind, space, key = self.datatype(a.dtype), self.dataspace(a.shape), name.encode() + b"\0"
        pad = lambda x: x + b"\0" * (-len(x) % 8)
        return struct.pack("<BBHHH", 1, 0, len(key), len(kind), len(space)) + pad(key) + pad(kind) + pad(space) + a.tobytes()

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b""
        for kind, data in messages:
            data += b"\0" * (-len(data) % 8)
            if len(data) >= 1 << 16:
                raise ValueError("an attribute of 64 KiB or more")
            body += struct.pack("<HHB3x", kind, len(data), 0) + data
        return self.put(struct.pack("<BBHIII", 1, 0, len(messages), 1, len(body), 0) + body)

    def dataset(self, a: np.ndarray, attributes: dict, chunks: tuple[int, ...] | None, level: int, shuffle: bool) -> int:
        messages = [(_SPACE, self.dataspace(a.shape)), (_TYPE, self.datatype(a.dtype))]
        if chunks is None or not a.ndim or not a.size:
            raw = np.ascontiguousarray(a).tobytes()
            messages.append((_LAYOUT, struct.pack("<BBQQ", 3, 1, self.put(raw) if raw else NOWHERE, len(raw))))
        else:
            leaves = []
            for k in np.ndindex(*[-(-n // c) for n, c in zip(a.shape, chunks, strict=True)]):
                first = tuple(i * c for i, c in zip(k, chunks, strict=True))
                part = np.zeros(chunks, a.dtype)
                own = a[tuple(slice(f, f + c) for f, c in zip(first, chunks, strict=True))]
                part[tuple(slice(0, n) for n in own.shape)] = own
                raw = part.tobytes()
                if shuffle:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, a.itemsize).T.tobytes()
                raw = zlib.compress(raw, level)
                leaves.append((struct.pack("<II", len(raw), 0) + struct.pack(f"<{a.ndim + 1}Q", *first, 0), self.put(raw)))
            end = struct.pack("<II", 0, 0) + struct.pack(f"<{a.ndim + 1}Q", *[-(-n // c) * c for n, c in zip(a.shape, chunks, strict=True)], 0)
            messages.append((_LAYOUT, struct.pack(f"<BBBQ{a.ndim + 1}I", 3, 2, a.ndim + 1, self.tree(1, leaves, end, 2 * self.CHILDREN), *chunks, a.itemsize)))
            filters = [(_SHUFFLE, [a.itemsize])] * shuffle + [(_DEFLATE, [level])]
            messages.append((_FILTERS, struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHHII", n, 0, 1, 1, v[0], 0) for n, v in filters)))
        return self.header(messages + [(_ATTRIBUTE, self.attribute(k, v)) for k, v in attributes.items()])

    def tree(self, kind: int, children: list[tuple[bytes, int]], end: bytes, most: int) -> int:
        """A version 1 tree over (key, address) in order, built from its leaves up."""
        level = 0
        while True:
            nodes = []
            for k in range(0, max(1, len(children)), most):
                part = children[k : k + most]
                last = children[k + most][0] if k + most < len(children) else end
                body = b"".join(key + struct.pack("<Q", at) for key, at in part) + last
                full = (len(end) + 8) * most + len(end)
                nodes.append((part[0][0] if part else end, self.put(struct.pack("<4sBBHQQ", b"TREE", kind, level, len(part), NOWHERE, NOWHERE) + body.ljust(full, b"\0"))))
            if len(nodes) == 1:
                return nodes[0][1]
            children, level = nodes, level + 1

    def group(self, members: dict[str, int], attributes: dict) -> tuple[int, int, int]:
        """(header, tree, heap) of a group over the addresses of its members."""
        names, heap = sorted(members, key=str.encode), b"\0" * 8
        at = {}
        for name in names:
            at[name] = len(heap)
            heap += name.encode() + b"\0"
            heap += b"\0" * (-len(heap) % 8)
        data = self.put(heap)
        heap_at = self.put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(heap), NOWHERE, data))
        leaves = []
        for k in range(0, max(1, len(names)), 2 * self.LEAF):
            part = names[k : k + 2 * self.LEAF]
            body = b"".join(struct.pack("<QQII16x", at[n], members[n], 0, 0) for n in part)
            node = self.put(struct.pack("<4sBBH", b"SNOD", 1, 0, len(part)) + body.ljust(40 * 2 * self.LEAF, b"\0"))
            leaves.append((struct.pack("<Q", at[names[k - 1]] if k else 0), node))
        tree = self.tree(0, leaves if names else [], struct.pack("<Q", at[names[-1]] if names else 0), 2 * 16)
        return self.header([(_SYMBOLS, struct.pack("<QQ", tree, heap_at)), *((_ATTRIBUTE, self.attribute(k, v)) for k, v in attributes.items())]), tree, heap_at


def hdf5_bytes(datasets: dict[str, np.ndarray], attributes: dict[str, dict] | None = None, chunks: tuple[int, ...] | None = None, level: int = 4, shuffle: bool = False) -> bytes:
    """An HDF5 file of arrays by their paths, with attributes by the paths of data sets and groups ('' is the root).
    Arrays are deflated in chunks of at most ``chunks`` cells, of whole arrays up to 256 a side where none is given."""
    attributes, out = attributes or {}, _Writer()
    tree: dict = {}
    for name in [*datasets, *attributes]:
        at = tree
        for part in [p for p in name.split("/") if p]:
            at = at.setdefault(part, {})

    def place(node: dict, path: str) -> int | tuple[int, int, int]:
        if path in datasets:
            a = np.asarray(datasets[path])
            if a.dtype.kind == "U":
                a = np.char.encode(a, "utf-8")
            own = chunks if chunks is not None and len(chunks) == a.ndim else (256,) * a.ndim
            return out.dataset(a, attributes.get(path, {}), tuple(max(1, min(c, n)) for c, n in zip(own, a.shape, strict=True)) if a.dtype.kind != "S" else None, level, shuffle)
        members = {k: place(v, f"{path}/{k}" if path else k) for k, v in node.items()}
        found = out.group({k: v[0] if isinstance(v, tuple) else v for k, v in members.items()}, attributes.get(path, {}))
        return found

    header, btree, heap = place(tree, "")
    head = SIGNATURE + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, out.LEAF, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, out.at, NOWHERE)
    head += struct.pack("<QQIIQQ", 0, header, 1, 0, btree, heap)
    return head.ljust(96, b"\0") + b"".join(out.parts)
