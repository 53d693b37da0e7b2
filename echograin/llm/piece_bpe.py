"""Encoding and decoding with a SentencePiece BPE model through a prefix table.

For each prefix of a text, the merge-type encoding has one last token.  The
table of these tokens is filled from left to right: an automaton over the
vocabulary names the tokens that end at a position, and the one whose
predecessor (the last token of the prefix before it) may stand beside it is
the entry.  Two tokens may stand beside each other if encoding their joined
strings would keep them apart; that is found by undoing their merges from the
latest on and asking at each step whether a merge over the border would have
come first.  Reading the table backwards from the end gives the ids.  The work
is linear in the text, whatever the merges are.

A text is cut wherever two ASCII characters meet that stand beside each other
in no piece, as no merge can join them; such are words before a space or a
line feed, and mostly letters before punctuation.  Equal segments are encoded
once and kept in a table of bounded size.

Defined results: null counts as the empty text, which has only the end id and
decodes to the empty text; characters outside the vocabulary become their
UTF-8 bytes' ids; repeated rows are encoded each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .textcols import byte_table, column_chunks, distinct_spans

MARK = "▁"
#: Segments kept per process: so many recent ones and as many of the time before.
KEPT = 150_000
#: Longer segments are encoded each time.
KEPT_LENGTH = 64

_ALL_BYTES = byte_table(b"", seed=2)[1]


class PieceModel:
    """Vocabulary of a model file with the tables of the pair test."""

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        self.strings = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        special = set()
        for i, s in enumerate(self.strings):
            if sp.is_byte(i):
                self.byte_ids[int(s[3:5], 16)] = i
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i):
                special.add(i)
        self.id_of_byte = {t: b for b, t in enumerate(self.byte_ids)}
        self.special = special
        order = {x: k for k, x in enumerate(sorted({sp.get_score(i) for i in range(n) if i not in special}, reverse=True))}
        self.rank = [order.get(sp.get_score(i), -1) for i in range(n)]
        self.ids = {s: i for i, s in enumerate(self.strings) if i not in special}
        known = set("".join(self.ids))
        for c in sorted(known - self.ids.keys()):  # characters that only stand in longer pieces
            self.ids[c] = len(self.strings)
            self.strings.append(c)
            self.rank.append(-1)
        #: by 256 * byte + next byte: whether no piece has these two ASCII characters in this order
        self.apart = np.zeros(1 << 16, bool)
        beside = {a + b for x in self.ids for a, b in zip(x, x[1:], strict=False)}
        for a in range(128):
            for b in range(128):
                self.apart[256 * a + b] = (chr(a) + chr(b)).replace(" ", MARK) not in beside
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(s) == 1 or self._made_of(s, i):
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.recent: dict[bytes, tuple[int, str, str]] = {}
        self.older: dict[bytes, tuple[int, str, str]] = {}
        self.id_texts = [f" {i}" for i in range(n)]
        self.texts = ["" if i in special else x.replace(MARK, " ") for i, x in enumerate(self.strings)]
        self.sizes = [len(x) for x in self.strings]

    def _made_of(self, s: str, i: int) -> bool:
        """Notes the two halves of the last merge that makes s; false if merging s gives anything but s."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                j = self.ids.get(parts[k] + parts[k + 1])
                if j is not None and (best is None or self.rank[j] < best):
                    best, at = self.rank[j], k
            if best is None:
                return False
            if len(parts) == 2:
                self.halves[i] = (self.ids[parts[0]], self.ids[parts[1]])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    def beside(self, a: int, b: int) -> bool:
        """Whether encoding the joined strings of a and b gives a, b; kept in ``pairs``."""
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        found = self.pairs[a << 20 | b] = self._beside(a, b)
        return found

    def _beside(self, a: int, b: int) -> bool:
        # A merge over the border wins if it ranks before the merges undone so
        # far; among equal ranks the one further left wins.
        strings, rank, halves = self.strings, self.rank, self.halves
        before, or_equal = 1 << 60, False
        while True:
            joined = self.ids.get(strings[a] + strings[b])
            if joined is not None and (rank[joined] < before or or_equal and rank[joined] == before):
                return False
            left, right = halves.get(a), halves.get(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and rank[a] > rank[b]):
                before, or_equal, a = rank[a], False, left[1]
            else:
                before, or_equal, b = rank[b], True, right[0]

    def encode_segment(self, s: str) -> list[int]:
        """Ids of a text whose spaces are marks."""
        n, sizes, pairs = len(s), self.sizes, self.pairs
        last = [-1] * (n + 1)  # last[k]: the last token of the first k characters; -1: a character that is in no piece
        filled = 0
        for end, token in self.automaton.iter(s):
            if end < filled:
                continue
            p = last[end + 1 - sizes[token]]
            if p < 0 or end + 1 == sizes[token]:
                fits = True
            elif (fits := pairs.get(p << 20 | token)) is None:
                fits = self.beside(p, token)
            if fits:
                last[end + 1] = token
                filled = end + 1
        out: list[int] = []
        while n:
            token = last[n]
            if token < 0 or self.rank[token] < 0:
                size = 1 if token < 0 else sizes[token]
                out.extend(self.byte_ids[x] for x in reversed(s[n - size : n].encode()))
                n -= size
            else:
                out.append(token)
                n -= sizes[token]
        out.reverse()
        return out

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids with the spaces of marks and without the first space that encoding put there."""
        out: list[str] = []
        raw = bytearray()

        def flush() -> None:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()

        for i in ids:
            if i in self.id_of_byte:
                raw.append(self.id_of_byte[i])
                continue
            if raw:
                flush()
            if i not in self.special:
                out.append(self.strings[i])
        if raw:
            flush()
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text

    def encode(self, text: str | None) -> list[int]:
        """All ids of one text, the end id included."""
        if not text:
            return [self.end]
        return [*self.encode_segment(MARK + text.replace(" ", MARK)), self.end]

    def segment(self, raw: bytes) -> tuple[int, str, str]:
        """(count of ids, ids as text with a space before each, decoded text) of a segment."""
        found = self.recent.get(raw)
        if found is None:
            found = self.older.get(raw)
            if found is None:
                ids = self.encode_segment(raw.decode().replace(" ", MARK))
                if self.id_of_byte.keys().isdisjoint(ids):
                    text = "".join([self.texts[i] for i in ids])
                else:
                    text = self.decode_ids([self.ids[MARK], *ids])
                found = (len(ids), "".join([self.id_texts[i] for i in ids]), text)
            if len(raw) <= KEPT_LENGTH:
                if len(self.recent) >= KEPT:
                    self.recent, self.older = {}, self.recent
                self.recent[raw] = found
        return found


_models: dict[str, PieceModel] = {}


def piece_model(model_file: str) -> PieceModel:
    if model_file not in _models:
        _models[model_file] = PieceModel(model_file)
    return _models[model_file]


def encoded_column(model: PieceModel, column: pa.Array) -> Iterator[tuple[int, str, str]]:
    """(count of ids, ids as text, decoded text) of every text of an Arrow string column."""
    column = pc.fill_null(column, "")
    if pc.any(pc.match_substring(column, MARK)).as_py():
        column = pc.replace_substring(column, MARK, " ")
    column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(" ", column, ""))
    end = f" {model.end}"
    for _, _, data, offsets in column_chunks(column):
        if not len(data):
            for _ in range(len(offsets) - 1):
                yield 1, end[1:], ""
            continue
        first = np.zeros(len(data), bool)
        first[1:] = model.apart[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
        first[offsets[offsets < len(data)]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        at, back = distinct_spans(data, starts, ends, _ALL_BYTES)
        raw = data.tobytes()
        found = [model.segment(raw[s:e]) for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        counts = np.fromiter((x[0] for x in found), np.int64, len(found))[back]
        ids, texts = np.array([x[1] for x in found], object)[back].tolist(), np.array([x[2] for x in found], object)[back].tolist()
        rows = np.searchsorted(starts, offsets).tolist()
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            text = "".join(texts[a:b])
            yield int(counts[a:b].sum()) + 1, ("".join(ids[a:b]) + end)[1:], text[1:] if text[:1] == " " else text


def encode_documents(docs: DataFrame, model_file: str, digests: bool = False) -> DataFrame:
    """doc_id with the ids (array) and their decoded text, or with n_tokens and the SHA-256 of both."""

    def ids_and_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        for batch in batches:
            rows = list(encoded_column(model, batch.column(1)))
            if digests:
                more = [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([sha256(r[1].encode()).hexdigest() for r in rows], pa.string()),
                    pa.array([sha256(r[2].encode()).hexdigest() for r in rows], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                more = [pa.array([np.array(r[1].split(" "), np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
                names = ["doc_id", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(ids_and_texts, f"doc_id {kind}, {schema}")


def op2_piece_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
