"""Cross-tokenizer alignment over elementary intervals of bytes.

Two tokenizers cut the bytes of a text (with one space before it) at two sets
of ends.  The sorted union of both is a list of elementary intervals; each
lies in one token of either side, found by a binary search among the ends, and
each is one overlap: one link.  Where an interval ends at an end of both
sides, a group closes; the links of a group are a part of the product of its
tokens, which group_products() expands.

A text is cut before it is encoded, in front of single spaces and between
letters and punctuation, wherever neither tokenizer joins or looks over the
place.  Such a place is an end on both sides, so segments are aligned each by
itself; equal segments are aligned once and kept in tables of bounded size.

Links are counted as pairs of ids by the number of documents that hold them.
Each document's distinct links, an id pair and a number in one long, are
written once to the shared folder; counting them is an aggregation with a
map-side part.  The ``FREQUENT`` most frequent pairs, a number of rows fixed
whatever the input, are broadcast to look up most links where they are; the
rest, none of which is frequent, goes through a join on the pair.

Defined results: texts that are null or empty, or whose tokens' bytes aren't
the text's (as with U+2581, which stands for a space), have no tokens, zeros
and an empty groups_sha256; rows that share a doc_id count each as a document;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_bpe import MARK, PieceModel
from .shared import shared_table
from .textcols import byte_table, column_chunks, distinct_spans

#: Segments kept per process: so many recent ones and as many of the time before; longer ones are aligned each time.
KEPT, KEPT_LENGTH = 80_000, 64
#: Pairs that are broadcast, of 16 bytes each.
FREQUENT = 1 << 20
#: An id pair is a * B_IDS + b.
B_IDS = 1 << 16

_VALUES = byte_table(b"", seed=12)[1]
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'"]] = True
_SPACE = 32


#: A segment's alignment, an Aligned as a plain tuple with the links as bytes of 32-bit numbers: small, and passed over by
#: the garbage collector.
Segment = tuple[int, int, int, bytes, str]


class Aligned(NamedTuple):
    """A text's alignment: counts of tokens and groups, its links as id pairs, its groups as text."""

    n_a: int
    n_b: int
    n_groups: int
    links: np.ndarray
    groups: str


NOTHING: Segment = (0, 0, 0, b"", "")


def elementary_intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner in a, owner in b, whether a group closes) of each interval between neighbouring ends; the last ends are equal."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def group_products(a: np.ndarray, b: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, token of a, token of b): all pairs of the tokens of each group, expanded from the intervals."""
    last = np.flatnonzero(closes)
    first = np.append(0, last[:-1] + 1)
    n_a, n_b = a[last] - a[first] + 1, b[last] - b[first] + 1
    size = n_a * n_b
    group = np.repeat(np.arange(len(last)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return group, a[first][group] + k // n_b[group], b[first][group] + k % n_b[group]


class Aligner:
    """Two tokenizers and the segments aligned so far."""

    def __init__(self, bytes_file: str, pieces_file: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_file)
        self.a.encode_special_tokens = True
        self.b, self.b_library = PieceModel(pieces_file), SentencePieceProcessor(model_file=pieces_file)
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b_bytes = [x.replace(MARK, " ").encode() for x in self.b.strings]
        for x, i in enumerate(self.b.byte_ids):
            self.b_bytes[i] = bytes([x])
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        if max(map(len, (self.a_bytes, self.b_bytes))) > B_IDS:
            raise ValueError("ids of both vocabularies have to fit 16 bits")
        self.recent: dict[bytes, Segment | None] = {}
        self.older: dict[bytes, Segment | None] = {}

    def segments(self, raw: list[bytes]) -> list[Segment | None]:
        """The alignment of each segment; None where a side's bytes aren't the segment's."""
        out: list = [None] * len(raw)
        missing = []
        for i, s in enumerate(raw):
            x = self.recent.get(s, missing)
            if x is missing:
                x = self.older.get(s, missing)
                if x is missing:
                    missing.append(i)
                    continue
                self.recent[s] = x
            out[i] = x
        for a in range(0, len(missing), 4096):
            part = missing[a : a + 4096]
            for i, x in zip(part, self._align([raw[i] for i in part]), strict=True):
                out[i] = x
                if len(raw[i]) <= KEPT_LENGTH:
                    self.recent[raw[i]] = x
        if len(self.recent) >= KEPT:
            self.recent, self.older = {}, self.recent
        return out

    def _piece_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of segments by the piece model.  The library puts a space before what it encodes, so it gets segments that
        begin with one; others are encoded by the prefix table."""
        led = [i for i, t in enumerate(texts) if t[0] == " " and len(t) > 1]
        out: list = [None] * len(texts)
        for i, ids in zip(led, self.b_library.encode([texts[i][1:] for i in led], num_threads=1) if led else (), strict=True):
            out[i] = ids
        return [self.b.encode_segment(t.replace(" ", MARK)) if x is None else x for x, t in zip(out, texts, strict=True)]

    def _align(self, raw: list[bytes]) -> list[Segment | None]:
        texts = [s.decode() for s in raw]
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = self._piece_ids(texts)
        whole, raw_ends, same = b"".join(raw), np.cumsum(list(map(len, raw))), True
        for ids, names, sizes in ((ids_a, self.a_bytes, self.a_sizes), (ids_b, self.b_bytes, self.b_sizes)):
            flat = list(chain.from_iterable(ids))
            ends = np.append(0, np.cumsum(sizes[flat]))[np.cumsum(list(map(len, ids)))]
            same = same and np.array_equal(ends, raw_ends) and b"".join([names[x] for x in flat]) == whole
        if same:
            return self._aligned(raw, ids_a, ids_b)
        good = [i for i, s in enumerate(raw) if b"".join([self.a_bytes[x] for x in ids_a[i]]) == s == b"".join([self.b_bytes[x] for x in ids_b[i]])]
        out: list[Segment | None] = [None] * len(raw)
        if good:
            for i, x in zip(good, self._aligned(*([y[i] for i in good] for y in (raw, ids_a, ids_b))), strict=True):
                out[i] = x
        return out

    def _aligned(self, raw: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[Segment]:
        """Segments whose tokens' bytes are theirs, all one after the other: a segment's end is an end of both sides."""
        flat_a, flat_b = (np.array(list(chain.from_iterable(x)), np.int64) for x in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.a_sizes[flat_a]), np.cumsum(self.b_sizes[flat_b])
        a, b, closes = elementary_intervals(ends_a, ends_b)
        pairs = (flat_a[a] * B_IDS + flat_b[b]).astype(np.uint32).tobytes()
        # token ranges of the groups, and which group each segment ends with
        last = np.flatnonzero(closes)
        names = self.names
        names_a, names_b = [names[x] for x in flat_a.tolist()], [names[x] for x in flat_b.tolist()]
        at_a = at_b = 0
        named = []
        for x, y in zip((a[last] + 1).tolist(), (b[last] + 1).tolist(), strict=True):
            left = names_a[at_a] if x - at_a == 1 else ",".join(names_a[at_a:x])
            named.append(f"{left}|{names_b[at_b] if y - at_b == 1 else ','.join(names_b[at_b:y])}")
            at_a, at_b = x, y
        closed = np.searchsorted(ends_a[a[last]], np.cumsum(list(map(len, raw)))) + 1
        upto = (last[closed - 1] + 1).tolist()
        begin_group = begin_link = 0
        out: list[Segment] = []
        for x, y, g, link in zip(ids_a, ids_b, closed.tolist(), upto, strict=True):
            out.append((len(x), len(y), g - begin_group, pairs[4 * begin_link : 4 * link], ";".join(named[begin_group:g])))
            begin_group, begin_link = g, link
        return out

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where segments start: before a space between two characters that aren't spaces, and between a letter and a
        mark, if no piece has the two characters beside each other."""
        n = len(data)
        first = np.zeros(n, bool)
        letter, mark = _LETTER[data], _MARK[data]
        word = letter | mark | ((data >= 48) & (data < 58))
        first[1:] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        if n > 2:
            first[1:-1] |= (data[1:-1] == _SPACE) & word[:-2] & word[2:]
        first[1:] &= self.b.apart[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
        first[offsets[offsets < n]] = True
        return np.flatnonzero(first)

    def column(self, column: pa.Array) -> Iterator[Aligned | None]:
        """The alignment of every text, a space before it; None where there are no tokens."""
        column = pc.fill_null(column, "")
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(" ", column, ""))
        for _, _, data, offsets in column_chunks(column):
            if not len(data):
                yield from [None] * (len(offsets) - 1)
                continue
            starts = self.cuts(data, offsets)
            ends = np.append(starts[1:], len(data))
            at, back = distinct_spans(data, starts, ends, _VALUES)
            raw = data.tobytes()
            found = self.segments([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            bad = np.array([x is None for x in found])[back]
            some = [x or NOTHING for x in found]
            counts = np.array([x[:3] for x in some], np.int64)[back]
            # the links of all segments in the order of the text
            n_links = np.array([len(x[3]) >> 2 for x in some], np.int64)
            first, own = np.cumsum(n_links) - n_links, n_links[back]
            upto = np.append(0, np.cumsum(own))
            links = np.frombuffer(b"".join([x[3] for x in some]), np.uint32)[np.arange(upto[-1]) + np.repeat(first[back] - upto[:-1], own)].astype(np.int64)
            names = np.array([*[x[4] for x in some], None], object)[back].tolist()
            rows = np.searchsorted(starts, offsets)
            lost = np.append(0, np.cumsum(bad))[rows]
            totals = np.diff(np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(counts, 0)])[rows], axis=0).tolist()
            for s, e, none, total in zip(rows[:-1].tolist(), rows[1:].tolist(), np.diff(lost).tolist(), totals, strict=True):
                if s == e or none:
                    yield None
                    continue
                yield Aligned(*total, links[upto[s] : upto[e]], ";".join(names[s:e]))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(bytes_file: str, pieces_file: str) -> Aligner:
    key = bytes_file, pieces_file
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def aligned_documents(docs: DataFrame, bytes_file: str, pieces_file: str, with_groups: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links[, groups]) of every row; row: a number of its own;
    links: each distinct id pair, a * B_IDS + b, plus its number of links times 2^32."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>" + ", groups string" * with_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, row = aligner(bytes_file, pieces_file), TaskContext.get().partitionId() << 33
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = list(tool.column(part.column(1)))
                links = []
                for x in found:
                    pairs, n = np.unique(x.links, return_counts=True) if x else (np.zeros(0, np.int64),) * 2
                    links.append(pairs + (n.astype(np.int64) << 32))
                counts = [(x.n_a, x.n_b, x.n_groups, len(x.links)) if x else (0, 0, 0, 0) for x in found]
                out = [pa.array(np.arange(row, row + len(found))), part.column(0), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True))]
                out += [pa.array([sha256(x.groups.encode()).hexdigest() if x else "" for x in found]), pa.array(links, pa.list_(pa.int64()))]
                if with_groups:
                    out.append(pa.array([x.groups if x else "" for x in found]))
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", *["groups"] * with_groups]
                yield pa.RecordBatch.from_arrays(out, names=names)
                row += len(found)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def group_pairs(docs: DataFrame, bytes_file: str, pieces_file: str) -> DataFrame:
    """(row, doc_id, group, a, b): the product of the ids of every group, expanded to a row a pair, for models that map
    whole groups onto each other."""
    found = aligned_documents(docs, bytes_file, pieces_file, with_groups=True).select("row", "doc_id", "groups")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(bytes_file, pieces_file)
        for batch in batches:
            for i, groups in enumerate(batch.column(2).to_pylist()):
                if not groups:
                    continue
                sides = [g.split("|") for g in groups.split(";")]
                ids_a, ids_b = (np.array([int(x) for side in sides for x in side[k].split(",")]) for k in (0, 1))
                ends = [np.cumsum([len(names[x]) for x in ids]) for ids, names in ((ids_a, tool.a_bytes), (ids_b, tool.b_bytes))]
                group, a, b = group_products(*elementary_intervals(*ends))
                for k in range(0, len(group), 100_000):
                    part = slice(k, k + 100_000)
                    n = len(group[part])
                    of = pa.array(np.full(n, i))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(group[part]), pa.array(ids_a[a[part]], pa.int32()), pa.array(ids_b[b[part]], pa.int32())], names=["row", "doc_id", "group", "a", "b"])

    return found.mapInArrow(run, f"row long, doc_id {kind}, group long, a int, b int")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that hold each pair, and whether no pair of the same first id has more."""
    counts = shared_table(links.groupBy("pair").agg(F.count("*").alias("n")))
    top = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("top"))
    return counts.join(top, F.shiftright("pair", 16) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, bytes_file: str, pieces_file: str, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs."""
    found = shared_table(aligned_documents(docs, bytes_file, pieces_file))
    links = found.select("row", F.explode("links").alias("link")).select("row", F.col("link").bitwiseAND(0xFFFFFFFF).alias("pair"), F.shiftright("link", 32).alias("times"))
    counts = shared_table(pair_counts(links))
    most = counts.orderBy(F.desc("n"), "pair").limit(frequent)
    most = F.broadcast(shared_table(most) if counts.count() > frequent else counts)
    totals = lambda df: df.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    known = totals(links.join(most, "pair"))
    rest = totals(links.join(most, "pair", "left_anti").join(counts.hint("merge"), "pair"))
    sums = known.union(rest).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    none = F.lit(0).cast("long")
    out = found.drop("links").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
