"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens; they are dealt evenly
to shards of about ``shard_items`` (by a number given to each row, so repeated
ids don't crowd a shard), and each shard is solved on several islands.  An
island breeds its own population of packings; after an epoch its elite goes to
the next island of its ring, which goes on with it.  The best packing of a
shard's islands counts.  What lies in the worse filled sequences of all shards
is dealt to new shards and packed again; that counts if it needs fewer.

A packing is a grouping: crossover injects some of the other parent's
best-filled bins whole, drops the bins that hold one of their pieces, and puts
the displaced pieces into the remaining bins by best fit.  Populations start
from best fit in decreasing order of sizes that are blurred by other amounts on
each island.  Every island breeds at least one generation an epoch, and more
while its best packing has more than ``ceil(tokens / capacity)`` bins, as no
packing can have fewer.

Only (row, length) of the pieces moves between tasks, never token ids, and
between epochs one row an island.
Defined results: null or empty text is one piece that holds the end id;
repeated rows are packed each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import random
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_table
from .textcols import SPACE_BYTES, byte_table, column_chunks, distinct_spans, mix64, spans

CAPACITY = 4096
END_ID = 1
#: Words kept per process: so many recent ones and as many of the time before.
KEPT = 200_000

_FOLDED = byte_table(SPACE_BYTES, fold_case=True, seed=3)
_AS_IT_IS = byte_table(SPACE_BYTES, seed=4)
_FOLD = bytes(range(256)).lower()


#: ASCII letters, and ASCII characters that are neither letters, digits, space, controls nor the apostrophe of contractions.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True


class WordTokenizer:
    """Token ids of whole columns.  The tokenizer drops white space and never joins over
    it, nor a letter with a punctuation mark, so a text is cut there; equal parts have
    equal ids and are given to the library once."""

    def __init__(self, file: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        out: list = [None] * len(words)
        missing = []
        for i, k in enumerate(words):
            x = self.recent.get(k)
            if x is None:
                x = self.older.get(k)
                if x is None:
                    missing.append(i)
                    continue
                self.recent[k] = x
            out[i] = x
        if missing:
            for i, e in zip(missing, self.library.encode_batch_fast([words[i].decode() for i in missing], add_special_tokens=False), strict=True):
                out[i] = array("I", e.ids).tobytes()
                if len(words[i]) <= 64:
                    self.recent[words[i]] = out[i]
        if len(self.recent) >= KEPT:
            self.recent, self.older = {}, self.recent
        return out

    def column(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of every text."""
        for _, _, data, offsets in column_chunks(column):
            raw = data.tobytes()
            # special tokens are found before the case is folded
            special = b"<|" in raw
            sep, values = _AS_IT_IS if special else _FOLDED
            starts, ends, rows = spans(~sep[data], offsets)
            if len(data) and not special:
                letter, mark = _LETTER[data], _MARK[data]
                inner = np.flatnonzero((letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])) + 1
                inner = inner[~np.isin(inner, offsets)]  # a text's start is a start already
                starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
                rows = np.searchsorted(starts, offsets)
            at, back = distinct_spans(data, starts, ends, values, None if special else _FOLD)
            words = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            found = self.words(words if special else [w.lower() for w in words])
            all_ids = np.array([*found, None], object)[:-1][back].tolist()
            rows = rows.tolist()
            for a, b in zip(rows[:-1], rows[1:], strict=True):
                yield b"".join(all_ids[a:b])


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(file: str) -> WordTokenizer:
    if file not in _tokenizers:
        _tokenizers[file] = WordTokenizer(file)
    return _tokenizers[file]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row[, ids]): the pieces of every document; row: a number of its own."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, row = word_tokenizer(tokenizer_file), TaskContext.get().partitionId() << 33
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            of, numbers, parts = [], [], []
            for i, ids in enumerate(tokenizer.column(batch.column(1))):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    of.append(i)
                    numbers.append((k // (4 * capacity), k // 4, len(part) // 4, crc32(part), row))
                    row += 1
                    if with_ids:
                        parts.append(np.frombuffer(part, "<i4"))
            columns = [pa.array(x, pa.int64()) for x in (zip(*numbers, strict=True) if numbers else [[]] * 5)]
            columns[0] = columns[0].cast(pa.int32())
            out = [batch.column(0).take(pa.array(of, pa.int64())), *columns]
            if with_ids:
                out.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class _Free:
    """Bins by free room; the fullest bin that has room for a size is found by a bit scan."""

    def __init__(self, capacity: int):
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, bin_: int, room: int) -> None:
        if room:
            self.stacks[room].append(bin_)
            self.mask |= 1 << room

    def best(self, size: int) -> tuple[int, int] | None:
        rest = self.mask >> size
        if not rest:
            return None
        room = size + (rest & -rest).bit_length() - 1
        stack = self.stacks[room]
        bin_ = stack.pop()
        if not stack:
            self.mask ^= 1 << room
        return bin_, room


def best_fit(sizes: list[int], order: list[int], bins: list[int], free: _Free, next_bin: int, capacity: int) -> int:
    """Puts the items of ``order`` into ``bins`` (by item); the new number of bins."""
    for i in order:
        found = free.best(sizes[i])
        if found is None:
            found = next_bin, capacity
            next_bin += 1
        bins[i] = found[0]
        free.put(found[0], found[1] - sizes[i])
    return next_bin


class Population:
    """Packings of one shard on one island."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int, size: int = 4):
        self.sizes, self.list, self.capacity, self.size = sizes, sizes.tolist(), capacity, size
        self.random = random.Random(seed)
        self.least = max(1, -(-int(sizes.sum()) // capacity))
        self.members: list[tuple[tuple, np.ndarray]] = []

    def sow(self, blur: float = 0.0) -> Population:
        """The first members; the k-th has its sizes blurred by up to blur + k / 10 before they are put in order."""
        for k in range(self.size):
            noise = np.random.default_rng(self.random.randrange(1 << 30)).uniform(1 - min(0.9, blur + 0.1 * k), 1, len(self.sizes))
            bins = [0] * len(self.sizes)
            best_fit(self.list, np.argsort(-self.sizes * noise, kind="stable").tolist(), bins, _Free(self.capacity), 0, self.capacity)
            self.add(np.array(bins, np.int64))
        return self

    def loads(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.sizes).astype(np.int64)

    def add(self, bins: np.ndarray) -> None:
        """Fitness: fewer bins, then better filled ones; equally fit packings count once."""
        loads = self.loads(bins)
        fitness = (int((loads > 0).sum()), -float(np.square(loads / self.capacity).sum()))
        if fitness not in [m[0] for m in self.members]:
            self.members.append((fitness, bins))
            self.members.sort(key=lambda m: m[0])
            del self.members[self.size :]

    def done(self) -> bool:
        return self.members[0][0][0] <= self.least

    @property
    def elite(self) -> np.ndarray:
        return self.members[0][1]

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        loads = self.loads(b)
        full = np.argsort(-loads, kind="stable")[: max(1, int((loads > 0).sum()) // 2)]
        taken = np.zeros(len(loads), bool)
        taken[self.random.sample(full.tolist(), self.random.randint(1, max(1, len(full) // 2)))] = True
        injected = taken[b]
        broken = np.zeros(int(a.max()) + 1, bool)
        broken[a[injected]] = True
        child = np.where(injected, b + len(broken), a)
        displaced = np.flatnonzero(~injected & broken[a])
        child[displaced] = -1
        kept, child = np.unique(child, return_inverse=True)
        child = child - int(kept[0] == -1)
        rooms = self.capacity - np.bincount(child[child >= 0], self.sizes[child >= 0]).astype(np.int64)
        free, out = _Free(self.capacity), child.tolist()
        for k, room in enumerate(rooms.tolist()):
            free.put(k, room)
        order = displaced[np.argsort(-self.sizes[displaced], kind="stable")].tolist()
        best_fit(self.list, order, out, free, len(rooms), self.capacity)
        return np.array(out, np.int64)

    def evolve(self, generations: int) -> Population:
        """At least one generation, and up to ``generations`` of them until the bound is met."""
        for _ in range(generations):
            if len(self.members) > 1:
                a, b = self.random.sample(range(len(self.members)), 2)
            else:  # a packing is crossed with itself: some of its full bins stay, the others are packed anew
                a = b = 0
            self.add(self.cross(self.members[a][1], self.members[b][1]))
            if self.done():
                break
        return self


_ISLAND = "shard int, island int, rows binary, sizes binary, members array<binary>, bins long, squares double"


def _island(shard: int, island: int, rows: bytes, population: Population) -> pd.DataFrame:
    """A population as one row."""
    (bins, squares), _ = population.members[0]
    members = [m[1].astype("<i4").tobytes() for m in population.members]
    return pd.DataFrame({"shard": [shard], "island": [island], "rows": [rows], "sizes": [population.sizes.astype("<i4").tobytes()], "members": [members], "bins": [bins], "squares": [squares]})


def _seed(shard: int, island: int, epoch: int) -> int:
    return int(mix64(np.array([(shard << 20) + (island << 8) + epoch], np.uint64))[0] >> np.uint64(1))


def pack_shards(items: DataFrame, shards: int, first_shard: int = 0, capacity: int = CAPACITY, islands: int = 2, generations: int = 8, epochs: int = 2) -> DataFrame:
    """(row, length, sequence_id, offset, load) of every item (row, length); load: tokens of its sequence."""
    keys = ["shard", "island"]
    spread = (F.pmod(F.xxhash64("row", F.lit(first_shard)), F.lit(shards)) + first_shard).cast("int")
    items = items.select("row", "length", spread.alias("shard"), F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        population = Population(pdf["length"].to_numpy(np.int64), capacity, _seed(*key, 0)).sow(0.1 * key[1])
        return _island(*key, pdf["row"].to_numpy().astype("<i8").tobytes(), population.evolve(generations))

    def go_on(epoch: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf.iloc[0]
            population = Population(np.frombuffer(own["sizes"], "<i4").astype(np.int64), capacity, _seed(*key, epoch))
            for bins in [*own["members"], own["guest"]]:
                population.add(np.frombuffer(bins, "<i4").astype(np.int64))
            return _island(*key, own["rows"], population.evolve(generations))

        return run

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, rows, sizes, bins in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, sizes, bins = np.frombuffer(rows, "<i8"), np.frombuffer(sizes, "<i4").astype(np.int64), np.frombuffer(bins, "<i4")
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                first = np.append(True, np.diff(bins[order]) != 0)
                offset = before - np.maximum.accumulate(np.where(first, before, 0))
                columns = [rows[order], sizes[order], (np.int64(shard) << 32) + bins[order].astype(np.int64), offset, np.bincount(bins, sizes).astype(np.int64)[bins[order]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "length", "sequence_id", "offset", "load"])

    state = items.groupBy(*keys).applyInPandas(settle, _ISLAND)
    for epoch in range(1, epochs):
        state = shared_table(state)
        # to the next island of the ring
        guests = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("members")[0].alias("guest"))
        state = state.join(guests, keys).groupBy(*keys).applyInPandas(go_on(epoch), _ISLAND)
    best = state.groupBy("shard").agg(F.min_by(F.struct("rows", "sizes", F.col("members")[0].alias("elite")), F.struct("bins", "squares", "island")).alias("best"))
    return shared_table(best.select("shard", "best.*").mapInArrow(placed, "row long, length long, sequence_id long, offset long, load long"))


def pack(items: DataFrame, capacity: int = CAPACITY, shard_items: int = 8192, well_filled: float = 0.98, **search) -> DataFrame:
    """(row, sequence_id, offset) of every item (row, length), lengths from 1 to capacity.

    Sequences filled less than ``well_filled`` are those that the last pass over
    all shards packs again.
    """
    shards = max(1, -(-items.count() // shard_items))
    out = pack_shards(items, shards, 0, capacity, **search)
    if shards > 1:
        poor = F.col("load") < well_filled * capacity
        n_items, before = out.where(poor).agg(F.count("*"), F.coalesce(F.sum((F.col("offset") == 0).cast("long")), F.lit(0))).first()
        if before > 1:
            again = pack_shards(out.where(poor).select("row", "length"), max(1, -(-n_items // shard_items)), shards, capacity, **search)
            if again.where("offset = 0").count() < before:
                out = out.where(~poor).union(again)
    return out.select("row", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False, **more) -> DataFrame:
    """The pieces of every document with their place: sequence_id and offset."""
    cut = shared_table(pieces(docs, tokenizer_file, capacity, with_ids))
    placed = pack(cut.select("row", "length"), capacity, **more)
    return cut.join(placed, "row").drop("row")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
