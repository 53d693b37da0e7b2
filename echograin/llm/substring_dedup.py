"""Substring dedup over fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``block`` words;
a window of ``window >= 2 * block - 1`` words holds at least one of them whole.
The blocks are the index; every rolling window of ``block`` words of every
document probes it.  A block that is met at a second place is an anchor, and
around the anchors the text is extended: the windows of ``window`` words that
hold an anchor are compared, and runs of windows that were met earlier make the
maximal repeats, whose words are removed.  A window is repeated if its word sequence also starts earlier, in a smaller doc_id or
further ahead in the same document; all of it is judged on the input.

The tables between the steps are packed: a task sends, for each bucket of the
hash space, one row with sorted hashes and the places they are from, and of
equal hashes in a task only the first, as the others are known to repeat
there.  So a passage that stands in every document costs a bucket one entry a
task, and no step gathers the places of one passage.  The number of buckets
follows the size of the text, so a bucket holds about ``per_bucket`` windows
and its false matches (32 bits of hash beside the bucket) stay as rare at any
size; they only make a window a candidate.  A row names the documents of its
own bucket alone, so rows grow with the text.  Candidates are compared by two
hashes of their words, 96 bits in all: among 1e13 windows a false match is
expected once in a thousand runs.

Defined results: null text has no words; a null doc_id comes before all
others; rows with the same doc_id and text are the same document, and get the
same result; texts that share a doc_id are documents in the order of a hash of
their text; documents of fewer than ``window`` words lose nothing; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcols import FIRST, SECOND, SPACE_BYTES, byte_table, column_chunks, hash_spans, mix64, spans, window_hashes

_SEP, _VALUES = byte_table(SPACE_BYTES, seed=7)
#: Text that one packed row group covers.
UNIT_BYTES = 8 << 20
ALIGNED = np.uint16(1 << 15)


class _Unit:
    """Windows of some documents."""

    def __init__(self, column: pa.Array, first: int, last: int):
        self.first, self._texts = first, column.slice(first, last - first)
        words, counts = [], []
        for _, _, data, offsets in column_chunks(self._texts):
            starts, ends, rows = spans(~_SEP[data], offsets)
            words.append(hash_spans(data, starts, ends, _VALUES, FIRST))
            counts.append(np.diff(rows))
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.rows = np.append(0, np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64)))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first word, row) of the windows."""
        h, at = window_hashes(self.words, self.rows, size)
        return h, at, np.searchsorted(self.rows, at, "right") - 1

    def checks(self, size: int) -> np.ndarray:
        """A second hash of the same windows, from the bytes of their words by other keys."""
        words = [np.zeros(0, np.uint64)]
        for _, _, data, offsets in column_chunks(self._texts):
            starts, ends, _ = spans(~_SEP[data], offsets)
            words.append(hash_spans(data, starts, ends, _VALUES, SECOND))
        return (window_hashes(np.concatenate(words), self.rows, size)[0] >> np.uint64(32)).astype(np.uint32)


def _units(column: pa.Array) -> Iterator[_Unit]:
    """Units of about UNIT_BYTES, and of fewer rows than an ordinal has room for."""
    for a, b, _, _ in column_chunks(column, UNIT_BYTES):
        for k in range(a, b, int(ALIGNED) - 1):
            yield _Unit(column, k, min(b, k + int(ALIGNED) - 1))


def _packed(x: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers by byte planes, each deflated if its bytes are far from uniform; of rising numbers the steps."""
    if rising:
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = x.view(np.uint8).reshape(len(x), -1)
    parts = [struct.pack("<cq", x.dtype.char.encode(), len(x))]
    for k in range(planes.shape[1]):
        plane = np.ascontiguousarray(planes[:, k])
        share = np.bincount(plane[:4096], minlength=256) / max(1, len(plane[:4096]))
        deflate = -(share[share > 0] * np.log2(share[share > 0])).sum() < 6.5
        part = zlib.compress(plane.tobytes(), 1) if deflate else plane.tobytes()
        parts += [struct.pack("<?q", deflate, len(part)), part]
    return b"".join(parts)


def _unpacked(x: bytes, rising: bool = False) -> np.ndarray:
    kind, n = struct.unpack_from("<cq", x)
    out = np.empty(n, np.dtype(kind.decode()))
    planes, at = out.view(np.uint8).reshape(n, -1), 9
    for k in range(out.itemsize):
        deflated, size = struct.unpack_from("<?q", x, at)
        part = x[at + 9 : at + 9 + size]
        planes[:, k] = np.frombuffer(zlib.decompress(part) if deflated else part, np.uint8)
        at += 9 + size
    return np.cumsum(out, dtype=out.dtype) if rising else out


def _groups(*in_order: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if not len(in_order[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in in_order])))


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n) if len(starts) else starts


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_key(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, its values as bytes)."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = _groups(keys)
    for a, b in zip(starts.tolist(), _ends(starts, len(keys)).tolist(), strict=True):
        yield int(keys[a]), values[a:b].tobytes()


_PROBES = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("hashes", pa.binary()), ("places", pa.binary()), ("id", pa.int64())])
_PROBES_DDL = "bucket int, docs binary, hashes binary, places binary, id long"
# what goes back to documents is packed by parts of the ids, so that its rows don't grow with documents times buckets
_HITS = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary())])
_HITS_DDL = "part int, ids binary, codes binary"
_WINDOWS = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("contents", pa.binary()), ("hashes", pa.binary()), ("checks", pa.binary()), ("places", pa.binary()), ("at", pa.binary()), ("id", pa.int64()), ("content", pa.int64())])
_WINDOWS_DDL = "bucket int, ids binary, contents binary, hashes binary, checks binary, places binary, at binary, id long, content long"
_REPEATS = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("contents", pa.binary()), ("at", pa.binary())])
_REPEATS_DDL = "part int, ids binary, contents binary, at binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _probe(block: int, buckets: int):
    """(id, text) to the packed probes, and to hits where a block is met twice in a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for unit in _units(batch.column(1)):
                h, at, row = unit.windows(block)
                if not len(h):
                    continue
                aligned = (at - unit.rows[row]) % block == 0
                order = np.argsort(h)  # by bucket, then by the low half
                h, row, aligned = h[order], row[order], aligned[order]
                starts = _groups(h)
                met = np.diff(np.append(starts, len(h)))
                indexed = np.logical_or.reduceat(aligned, starts)
                rows = []
                again = np.repeat((met > 1) & indexed, met)
                bucket = _bucket_of(h, buckets)
                code = bucket[again] << 32 | (h[again] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                for doc, codes in _by_key(row[again], code):
                    rows.append((doc % buckets, None, codes, None, int(ids[unit.first + doc])))
                h, place, bucket = h[starts], row[starts].astype(np.uint16), bucket[starts]
                place |= np.where(indexed, ALIGNED, np.uint16(0))
                cuts = _groups(bucket)
                for a, b in zip(cuts.tolist(), _ends(cuts, len(h)).tolist(), strict=True):
                    used, there = np.unique(place[a:b] & ~ALIGNED, return_inverse=True)
                    there = there.astype(np.uint16) | place[a:b] & ALIGNED
                    rows.append((int(bucket[a]), _packed(ids[unit.first + used.astype(np.int64)], True), _packed((h[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32), True), _packed(there), None))
                yield _batch(rows, _PROBES)

    return run


def _parts(ids: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, which entries) of a spread of ids over as many parts as there are buckets."""
    part = (mix64(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((ids, part))
    starts = _groups(part[order])
    for a, b in zip(starts.tolist(), _ends(starts, len(order)).tolist(), strict=True):
        yield int(part[order[a]]), order[a:b]


def _match(buckets: int):
    """Probes of one bucket to its anchors, by the documents that hold them."""

    def run(table: pa.Table) -> pa.Table:
        hashes, docs, marks = [], [], []
        hit_docs, hit_codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        bucket = table.column("bucket")[0].as_py()
        for d, h, p, own in zip(*(table.column(c).to_pylist() for c in ("docs", "hashes", "places", "id")), strict=True):
            if d is None:  # known from within a unit
                hit_codes.append(np.frombuffer(h, "<i8"))
                hit_docs.append(np.full(len(hit_codes[-1]), own, np.int64))
                continue
            place = _unpacked(p)
            hashes.append(_unpacked(h, True))
            docs.append(_unpacked(d, True)[place & ~ALIGNED])
            marks.append(place & ALIGNED > 0)
        if hashes:
            h, doc, mark = np.concatenate(hashes), np.concatenate(docs), np.concatenate(marks)
            order = np.argsort(h, kind="stable")
            h, doc, mark = h[order], doc[order], mark[order]
            starts = _groups(h)
            met = np.diff(np.append(starts, len(h)))
            hit = np.repeat((met > 1) & np.logical_or.reduceat(mark, starts), met)
            hit_docs.append(doc[hit])
            hit_codes.append(h[hit].astype(np.int64) | bucket << 32)
        doc, code = np.concatenate(hit_docs), np.concatenate(hit_codes)
        rows = [(part, _packed(doc[k], True), _packed(code[k])) for part, k in _parts(doc, buckets)]
        return pa.Table.from_batches([_batch(rows, _HITS)], schema=_HITS)

    return run


def _gather_hits(table: pa.Table) -> pa.Table:
    """Hits of one part of the ids to a row a document."""
    doc = np.concatenate([_unpacked(x, True) for x in table.column("ids").to_pylist()])
    code = np.concatenate([_unpacked(x) for x in table.column("codes").to_pylist()])
    rows = list(_by_key(doc, code))
    return pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), HITS: pa.array([r[1] for r in rows], pa.binary())})


def _extend(text_at: int, block: int, window: int, buckets: int):
    """(columns of documents, id, content, hits) to the packed windows around anchors, and to repeats known inside a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents, found_hits = batch.column(batch.num_columns - 3).to_numpy(), batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1)
            for unit in _units(batch.column(text_at)):
                n = len(unit.rows) - 1
                hits = [np.frombuffer(x, "<i8") for x in found_hits.slice(unit.first, n).to_pylist()]
                if not hits:
                    continue
                anchors = np.unique(np.concatenate(hits))
                h, at, _ = unit.windows(block)
                code = _bucket_of(h, buckets) << 32 | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
                found = np.minimum(np.searchsorted(anchors, code), len(anchors) - 1)
                total = np.zeros(len(unit.words) + 1, np.int64)
                total[at + 1] = anchors[found] == code
                total = np.cumsum(total)
                h, at, row = unit.windows(window)
                near = total[at + window - block + 1] > total[at]
                h, check, at, row = h[near], unit.checks(window)[near], at[near], row[near]
                at = at - unit.rows[row]
                doc, content = ids[unit.first + row], contents[unit.first + row]
                order = np.lexsort((at, content, doc, check, h))
                h, check, at, row, doc, content = h[order], check[order], at[order], row[order], doc[order], content[order]
                starts = _groups(h, check)
                first = np.repeat(starts, np.diff(np.append(starts, len(h))))
                later = (doc != doc[first]) | (content != content[first]) | (at != at[first])
                rows = [(int(r) % buckets, None, None, None, None, None, x, int(ids[unit.first + r]), int(contents[unit.first + r])) for r, x in _by_key(row[later], at[later].astype("<i4"))]
                # the documents that the row groups speak of
                used, place = np.unique(row[starts], return_inverse=True)
                h, check, at = h[starts], check[starts], at[starts].astype("<i4")
                bucket = _bucket_of(h, buckets)
                cuts = _groups(bucket)
                for a, b in zip(cuts.tolist(), _ends(cuts, len(h)).tolist(), strict=True):
                    own, there = np.unique(used[place[a:b]], return_inverse=True)
                    own += unit.first
                    rows.append((int(bucket[a]), _packed(ids[own], True), contents[own].astype("<i8").tobytes(), _packed(h[a:b], True), _packed(check[a:b]), _packed(there.astype(np.uint16)), _packed(at[a:b]), None, None))
                yield _batch(rows, _WINDOWS)

    return run


def _later(buckets: int):
    """Windows of one bucket to those whose words also start earlier."""

    def run(table: pa.Table) -> pa.Table:
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        parts: list[tuple] = []
        for ids, contents, h, check, p, at, own, content in zip(*(table.column(c).to_pylist() for c in ("ids", "contents", "hashes", "checks", "places", "at", "id", "content")), strict=True):
            if ids is None:  # known from within a unit
                starts = np.frombuffer(at, "<i4")
                found.append((np.full(len(starts), own, np.int64), np.full(len(starts), content, np.int64), starts))
                continue
            place = _unpacked(p)
            parts.append((_unpacked(h, True), _unpacked(check), _unpacked(ids, True)[place], np.frombuffer(contents, "<i8")[place], _unpacked(at)))
        if parts:
            h, check, doc, content, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, content, doc, check, h))
            h, check, doc, content, at = h[order], check[order], doc[order], content[order], at[order]
            starts = _groups(h, check)
            first = np.repeat(starts, np.diff(np.append(starts, len(h))))
            later = (doc != doc[first]) | (content != content[first]) | (at != at[first])
            found.append((doc[later], content[later], at[later]))
        doc, content, at = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = [(part, _packed(doc[k], True), _packed(content[k]), _packed(at[k])) for part, k in _parts(doc, buckets)]
        return pa.Table.from_batches([_batch(rows, _REPEATS)], schema=_REPEATS)

    return run


def _gather_repeats(table: pa.Table) -> pa.Table:
    """Repeats of one part of the ids to a row a doc_id: the content that each start is in, and the start."""
    doc = np.concatenate([_unpacked(x, True) for x in table.column("ids").to_pylist()])
    content = np.concatenate([_unpacked(x) for x in table.column("contents").to_pylist()])
    at = np.concatenate([_unpacked(x) for x in table.column("at").to_pylist()])
    a, b = list(_by_key(doc, content)), list(_by_key(doc, at))
    repeats = pa.StructArray.from_arrays([pa.array([x for _, x in a], pa.binary()), pa.array([x for _, x in b], pa.binary())], names=["content", "at"])
    return pa.table({"id": pa.array([i for i, _ in a], pa.int64()), REPEATS: repeats})


#: Names of columns that the steps add; where the documents have them, they get lines under their names.
ID, CONTENT, HITS, REPEATS = "__id", "__content", "__hits", "__repeats"


def free_name(name: str, taken: list[str]) -> str:
    """name, with lines behind it until no column is called so in any case."""
    while name.lower() in [c.lower() for c in taken]:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with two more columns, the id and the hash of the text."""
    lowest = F.lit(-(1 << 63)).cast("long")
    more = [F.coalesce(docs["doc_id"].cast("long"), lowest), F.xxhash64(F.coalesce(docs["text"], F.lit("")))]
    return docs.select("*", *[c.alias(free_name(n, docs.columns)) for c, n in zip(more, (ID, CONTENT), strict=True)])


def repeats(docs: DataFrame, window: int = 20, block: int = 10, per_bucket: int = 3_000_000) -> DataFrame:
    """(id, __repeats): by doc_id, the starts of repeated windows in packed arrays, each with the hash of the text
    that they are in; only documents that have some."""
    if window < 2 * block - 1:
        raise ValueError("a window has to hold a whole block wherever it starts")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // (6 * per_bucket)))
    keyed = _keyed(docs)
    key = keyed.columns[-2]
    probes = keyed.select(key, "text").mapInArrow(_probe(block, buckets), _PROBES_DDL)
    hits = probes.groupBy("bucket").applyInArrow(_match(buckets), _HITS_DDL)
    hits = hits.groupBy("part").applyInArrow(_gather_hits, f"id long, {HITS} binary")
    # all columns of the documents, so that this exchange of them also serves remove_repeats()
    near = keyed.join(hits, keyed[key] == hits["id"]).select(*(keyed[c] for c in keyed.columns), hits[HITS].alias(free_name(HITS, keyed.columns)))
    windows = near.mapInArrow(_extend(docs.columns.index("text"), block, window, buckets), _WINDOWS_DDL)
    later = windows.groupBy("bucket").applyInArrow(_later(buckets), _REPEATS_DDL)
    return later.groupBy("part").applyInArrow(_gather_repeats, f"id long, {REPEATS} struct<content: binary, at: binary>")


def _covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Words that the windows cover."""
    edge = np.zeros(n + 1, np.int64)
    at = np.unique(starts)
    edge[at] += 1
    np.subtract.at(edge, np.minimum(at + window, n), 1)
    return np.cumsum(edge)[:n] > 0


def remove_repeats(docs: DataFrame, window: int = 20, block: int = 10, digests: bool = False, **more) -> DataFrame:
    """Every row of docs without its repeated words, and with n_words and n_removed as its last two columns.

    A text that loses words becomes its kept words joined by one space; others
    stay as they are.  Columns of docs stay even if they are called n_words or
    n_removed; the counts then get a line behind their names.  With digests, only doc_id, n_words, n_removed and
    kept_sha256, of the kept words joined by one space.
    """
    if digests:
        docs = docs.select("doc_id", "text")
    found = repeats(docs, window, block, **more)
    keyed = _keyed(docs)
    key = keyed.columns[-2]
    joined = keyed.join(found, keyed[key] == found["id"], "left").select(*(keyed[c] for c in keyed.columns if c != key), found[REPEATS].alias(free_name(REPEATS, keyed.columns)))
    names = docs.columns
    text_at, doc_at = names.index("text"), names.index("doc_id")
    added = [T.StructField(free_name(n, names), T.LongType()) for n in ("n_words", "n_removed")]
    fields = [docs.schema["doc_id"], *added, T.StructField("kept_sha256", T.StringType())] if digests else [*docs.schema, *added]
    schema = T.StructType(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            for value, content, marks in zip(batch.column(text_at), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                starts = np.zeros(0, np.int64)
                if marks:
                    starts = np.frombuffer(marks["at"], "<i4")[np.frombuffer(marks["content"], "<i8") == content]
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                words = raw.split()
                n_words.append(len(words))
                if len(starts):
                    gone = _covered(starts, len(words), window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                if digests:
                    texts.append(sha256(b" ".join(words)).hexdigest())
                else:
                    texts.append(value.as_py() if not n_removed[-1] else b" ".join(words).decode())
            counts = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            if digests:
                columns = [batch.column(doc_at), *counts, pa.array(texts, pa.string())]
            else:
                columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(i) for i, n in enumerate(names)] + counts
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return joined.mapInArrow(cut, schema)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, ws[i:i+19] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20) t),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) t WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM r, (SELECT unnest(range(20)) AS o) z),
left_ AS (
  SELECT x.doc_id, count(*) AS n, string_agg(x.w, ' ' ORDER BY x.i) AS kept
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_ ON left_.doc_id = d.doc_id
"""
