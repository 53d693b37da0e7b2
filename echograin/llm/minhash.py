"""Near-duplicate documents by b-bit MinHash.

Each document becomes the set of its distinct 5-word shingles.  Documents of
equal sets form a class, whose smallest id stands for it from here on.  128
minima are taken over each class's set; 32 bands of 4 full minima name the
buckets in which candidates meet (a pair at the limit of 0.75 misses all bands
with a probability of 5e-6), and of every minimum the low 2 bits are packed
into a signature.  Within a bucket two signatures are compared by counting
equal bit pairs, and the share is corrected for pairs that are equal by chance:
``(share - 1/4) / (3/4)``.  Sizes that rule a link out are passed over.

A bucket isn't expanded into all pairs.  Every row travels; the member of the
smallest id becomes the hub of those near it, then the next that has no hub, so
that the buckets of one crowd name the same hubs.  Each member is tied to its
hub and to its likeliest partner, and these candidates are confirmed on the full sets
(a hub's set is made once a task for all its partners).  The confirmed links
make components.  A bucket of more than a few, in which other likely pairs were
passed over, stays open: if its members lie in more than one component, they
come again with their full sets, and each member outside the bucket's largest
component is compared with all likely members of other components, on the sets
themselves.  Only links that join two components leave the task, so what is
written follows the number of documents, whatever a crowd's pairs are, and no
link between two components is missed.

A bucket of more than ``per_part`` members is cut into parts, each led by
itself.  In the second pass the members of the largest component stay in their
part and only those outside it visit all parts.

Defined results: null text or text without words has the empty set, linked
with nothing; fewer than ``shingle`` words are one shingle; a row with null
doc_id is linked with nothing, has a null component and is kept; rows that
share a doc_id are one document with the links of any of its texts; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import hot_keys, shared_table, spread_join
from .textcols import FIRST, SPACE_BYTES, byte_table, column_chunks, hash_spans, mix64, spans, window_hashes

SHINGLE, HASHES, BANDS, BITS = 5, 128, 32, 2
PERCENT = 75
#: Estimates of the similarity: below LOW a link is ruled out (4.5 standard errors); from NEAR on a hub takes a member.
LOW, NEAR = 0.54, 0.70
#: Buckets of at most SMALL members give all their likely links; in larger ones a member gives its NEAREST and its hub's, and the rest in the second pass.
SMALL, NEAREST = 8, 1
#: Members of a bucket that meet in one task; more are cut into parts.
PER_PART = 4096
#: Shingles of the sets that meet in one task in the second pass, residents and visitors each.
PART_SHINGLES = 4_000_000
#: Crowded buckets are broadcast up to this number, beyond it they are joined by their key.
BROADCAST_ROWS = 200_000

_SEP, _VALUES = byte_table(SPACE_BYTES, fold_case=True, seed=8)
_RANDOM = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_FACTORS = (_RANDOM[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (_RANDOM[HASHES:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in column_chunks(column):
        starts, ends, rows = spans(~_SEP[data], offsets)
        words = hash_spans(data, starts, ends, _VALUES, FIRST)
        h, at = window_hashes(words, rows, shingle)
        cuts = np.searchsorted(at, rows)
        few = np.diff(rows)
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b > a:
                yield np.unique(h[a:b])
            elif few[k]:
                own = words[rows[k] : rows[k + 1]]
                yield window_hashes(own ^ np.uint64(len(own)), np.array([0, len(own)]), len(own))[0]
            else:
                yield np.zeros(0, np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each set, none of them empty."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(x * _FACTORS[k] + _SHIFTS[k], starts)
    return out


def signatures(low: np.ndarray) -> np.ndarray:
    """The low BITS of every (scrambled) minimum, packed to 64-bit words."""
    with np.errstate(over="ignore"):
        low = (low ^ low >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    low = (low ^ low >> np.uint32(12)).astype(np.uint64) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    return (low.reshape(len(low), -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's minima."""
    rows = HASHES // BANDS
    parts = low.reshape(len(low), BANDS, rows).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(BANDS, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix64(key ^ parts[:, :, r])
    return key


_PAIR_LOW = np.uint64(0x5555555555555555)


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of a signature with others."""
    differ = one ^ others
    unequal = np.bitwise_count((differ | differ >> np.uint64(1)) & _PAIR_LOW).sum(-1)
    chance = 1 / (1 << BITS)
    return (1 - unequal / HASHES - chance) / (1 - chance)


def _likely(ids: np.ndarray, sizes: np.ndarray, signs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members, their estimates against all members) by blocks of bounded memory; 0 where a link is ruled out by size, and for a member itself."""
    n = len(ids)
    block = max(1, (1 << 19) // n)
    for a in range(0, n, block):
        rows = np.arange(a, min(n, a + block))
        found = estimates(signs[rows][:, None, :], signs[None, :, :])
        found[100 * np.minimum(sizes[rows][:, None], sizes[None, :]) < PERCENT * np.maximum(sizes[rows][:, None], sizes[None, :])] = 0
        found[np.arange(len(rows)), rows] = 0
        yield rows, found


def lead(ids: np.ndarray, sizes: np.ndarray, signs: np.ndarray) -> tuple[set[tuple[int, int]], bool]:
    """(candidate links, were likely pairs passed over) of one bucket.

    In a small bucket all likely partners are links.  In a larger one the member
    of the smallest id is a hub and takes those near it, then the next among
    those left, and so on; each hub is tied to its own, and each member to its
    NEAREST likeliest partners.  Hubs by id are mostly the same in all buckets
    of a crowd, so a member has a few links, not some for each of its buckets.
    """
    n = len(ids)
    free = np.zeros(n, bool)
    links: set[tuple[int, int]] = set()
    passed = False
    for rows, found in _likely(ids, sizes, signs):
        if n <= SMALL:
            i, j = np.nonzero(found >= LOW)
        else:
            free[rows] = (found >= NEAR).any(1)
            passed = passed or bool(((found >= LOW).sum(1) > NEAREST).any())
            top = np.argpartition(-found, NEAREST, 1)[:, :NEAREST]
            i, k = np.nonzero(np.take_along_axis(found, top, 1) >= LOW)
            j = top[i, k]
        links.update(zip(ids[rows[i]].tolist(), ids[j].tolist(), strict=True))
    if n <= SMALL:
        return links, False
    for hub in np.argsort(ids).tolist():
        if not free[hub]:
            continue
        free[hub] = False
        own = np.flatnonzero(free)
        found = estimates(signs[hub], signs[own])
        found[100 * np.minimum(sizes[own], sizes[hub]) < PERCENT * np.maximum(sizes[own], sizes[hub])] = 0
        mine = own[found >= NEAR]
        free[mine] = False
        links.update(zip([int(ids[hub])] * len(mine), ids[mine].tolist(), strict=True))
    return links, passed


def join_components(ids: np.ndarray, visits: np.ndarray, stays: np.ndarray, component: np.ndarray, signs: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between members of different components of one group, enough to join all that are linked.

    Each member that visits is compared, on the full sets, with all likely ones
    that stay and that aren't yet in its component.
    """
    sizes = np.array([len(s) for s in sets])
    resident = np.flatnonzero(stays)
    if not len(resident):
        return []
    starts = np.append(0, np.cumsum(sizes[resident]))
    known, flat = np.unique(np.concatenate([sets[i] for i in resident]), return_inverse=True)
    mark = np.zeros(len(known), bool)
    _, root = np.unique(component, return_inverse=True)
    links = []
    for i in np.flatnonzero(visits).tolist():
        fits = 100 * np.minimum(sizes[resident], sizes[i]) >= PERCENT * np.maximum(sizes[resident], sizes[i])
        some = np.flatnonzero(fits & (root[resident] != root[i]))
        some = some[estimates(signs[i], signs[resident[some]]) >= LOW]
        if not len(some):
            continue
        at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
        at = at[known[at] == sets[i]]
        mark[at] = True
        # the shingles of those in question, one after the other
        n = starts[some + 1] - starts[some]
        begin = np.append(0, np.cumsum(n))
        both = np.add.reduceat(mark[flat[np.arange(begin[-1]) - np.repeat(begin[:-1] - starts[some], n)]], begin[:-1], dtype=np.int64)
        mark[at] = False
        for j in resident[some[(both > 0) & (100 * both >= PERCENT * (sizes[i] + n - both))]].tolist():
            if root[j] != root[i]:
                links.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return links


_ROWS_DDL = "key long, id long, size int, sign binary"


def _linked(links: list[tuple[int, int]] | set[tuple[int, int]]) -> np.ndarray:
    """Distinct links, the smaller id first."""
    pairs = np.unique(np.sort(np.array(list(links), np.int64).reshape(-1, 2), 1), axis=0)
    return pairs[pairs[:, 0] != pairs[:, 1]]


def _signs(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), HASHES * BITS // 64)


def _minima(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, size, minima) to a row for each band."""
    for batch in batches:
        low = _minima(batch.column(2))
        row = np.repeat(np.arange(batch.num_rows), BANDS)
        sign = pa.array([x.tobytes() for x in signatures(low)] if len(low) else [], pa.binary())
        ids, sizes = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
        yield pa.RecordBatch.from_arrays([pa.array(band_keys(low).ravel().view(np.int64)), pa.array(ids), pa.array(sizes, pa.int32()), sign.take(pa.array(row))], names=["key", "id", "size", "sign"])


def _bucket_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """minima to the buckets of a batch, each with its number of members there."""
    for batch in batches:
        keys, n = np.unique(band_keys(_minima(batch.column(0))).ravel(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


def crowded_buckets(leaders: DataFrame, per_part: int) -> DataFrame:
    """(key, n): the buckets of more than per_part members, however thinly they lie over the batches.  All buckets are
    counted, which sends 32 numbers a text; it is what cutting them into parts rests on."""
    met = leaders.select("minima").mapInArrow(_bucket_keys, "key long, n long")
    return shared_table(met.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > per_part))


def _by_group(batches: Iterator[pa.RecordBatch], done: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """done(rows, starts of their groups) over rows in the order of (key, part), all rows of a key in one call."""

    def groups(table: pa.Table) -> pa.RecordBatch:
        keys, parts = table["key"].to_numpy(), table["part"].to_numpy()
        return done(table, np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1]))))

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, parts = batch.column("key").to_numpy(), batch.column("part").to_numpy()
        last = (keys == keys[-1]) & (parts == parts[-1])  # the last group may go on in the next batch
        cut = int(np.argmax(last))
        if rest and cut == 0:
            before = rest[-1]
            if before["key"][0].as_py() == keys[0] and before["part"][0].as_py() == parts[0]:
                rest.append(batch)
                continue
            yield groups(pa.Table.from_batches(rest))
            rest = [batch]
            continue
        if cut:
            yield groups(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
        rest = [batch.slice(cut)]
    if rest:
        yield groups(pa.Table.from_batches(rest))


_MET_DDL = "a long, b long, key long, size int, sign binary"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band rows (key, part, id, size, sign, cut) in order to candidate links (a, b) and the members (a, key, size, sign) of
    open buckets; cut: whether the bucket lies in several parts, which haven't all met."""

    def done(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        keys, ids, sizes, signs, cut = rows["key"].to_numpy(), rows["id"].to_numpy(), rows["size"].to_numpy(), _signs(rows["sign"]), rows["cut"].to_numpy()
        ends = np.append(starts[1:], len(keys))
        pair = starts[ends - starts == 2]  # most buckets that have more than one
        small, large = np.minimum(sizes[pair], sizes[pair + 1]), np.maximum(sizes[pair], sizes[pair + 1])
        pair = pair[(100 * small >= PERCENT * large) & (estimates(signs[pair], signs[pair + 1]) >= LOW)]
        links = [np.stack([ids[pair], ids[pair + 1]], 1)]
        left = cut.copy()
        many = ends - starts > 2
        for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            found, passed = lead(ids[a:b], sizes[a:b], signs[a:b])
            links.append(np.array(list(found), np.int64).reshape(-1, 2))
            left[a:b] |= passed
        pairs, members = _linked(np.concatenate(links)), rows.filter(pa.array(left)).combine_chunks()
        none = pa.nulls(len(members), pa.int64())
        member = [members[c].combine_chunks() if len(members) else pa.nulls(0, members.schema.field(c).type) for c in ("id", "key", "size", "sign")]
        columns = [pa.concat_arrays([pa.array(pairs[:, 0]), member[0]]), pa.concat_arrays([pa.array(pairs[:, 1]), none]), *[pa.concat_arrays([pa.nulls(len(pairs), m.type), m]) for m in member[1:]]]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", "size", "sign"])

    return _by_group(batches, done)


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of open buckets (key, part, id, stays, visits, component, sign, shingles) in order to confirmed links (a, b)."""

    def done(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, stays, visits, component = (rows[c].to_numpy() for c in ("id", "stays", "visits", "component"))
        signs, shingles = _signs(rows["sign"]), rows["shingles"]
        links = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
            sets = [np.frombuffer(x, "<u8") for x in shingles.slice(a, b - a).to_pylist()]
            links += join_components(ids[a:b], visits[a:b], stays[a:b], component[a:b], signs[a:b], sets)
        pairs = _linked(links)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return _by_group(batches, done)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, size, class, minima)."""
    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        full = [s for s in sets if len(s)]
        low = iter(minima(full).astype("<u4") if full else ())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(low).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            names=["doc_id", "size", "class", "minima"],
        )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text), a row of a itself (b null) before those of its partners, to the links whose full sets are similar enough."""
    hub: int | None = None
    own: list[np.ndarray] = []
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = np.zeros(batch.num_rows, bool)
        for k, x in enumerate(shingle_sets(batch.column(2))):
            if b[k] is None:
                # rows that share a doc_id come one after the other; their sets are one document's
                if hub != a[k]:
                    hub, own = a[k], [x]
                elif not any(np.array_equal(x, y) for y in own):
                    own.append(x)
                continue
            for y in own if hub == a[k] else ():
                both = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
                keep[k] |= both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _confirmed(texts: DataFrame, links: DataFrame) -> DataFrame:
    """The links (a, b) whose texts (id, text) are similar enough.  The links of one a are dealt over tasks by their
    number, and its text goes to each of them once.  Joined by sort-merge at every size, so that the plan of a small
    input is that of a large one."""
    hot = hot_keys(links, "a")
    dealt = links.join(F.broadcast(hot), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    partners = spread_join(dealt, texts.withColumnRenamed("id", "b"), "b", hot_keys(links, "b"), "a", "inner", "merge").select("a", "salt", "b", "text")
    own = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a").hint("merge"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = partners.union(own).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return rows.select("a", "b", "text").mapInArrow(_confirm, "a long, b long").distinct()


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, its sorted shingle hashes)."""
    for batch in batches:
        sets = [x.astype("<u8").tobytes() for x in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])


def _joined_up(texts: DataFrame, rows: DataFrame, found: DataFrame, per_part: int) -> DataFrame:
    """Confirmed links (a, b) between the components (id, component) of members (key, id, size, sign) of open buckets.

    A bucket's members stay in parts of about per_part members, fewer if their
    sets are large; those outside its largest component visit all parts, as many
    at a time.
    """
    rows = shared_table(rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
    buckets = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("s")).groupBy("key")
    largest = F.struct("n", "component")
    buckets = buckets.agg(
        F.max_by("component", largest).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), (F.sum("n") - F.max("n")).alias("n_outside"), (F.sum("s") - F.max_by("s", largest)).alias("s_outside")
    ).where("n_outside > 0")
    cut = lambda n, shingles: F.greatest(F.ceil(F.col(n) / per_part), F.ceil(F.col(shingles) / PART_SHINGLES)).cast("int")
    parts, guests = cut("n", "s"), cut("n_outside", "s_outside")
    rows = spread_join(rows, buckets, "key", hot_keys(rows, "key"), "id", "inner").withColumns({"outside": F.col("component") != F.col("main"), "parts": parts, "guests": guests})
    home, guest = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("guests")).cast("int")
    role = lambda r, v, stays, visits: F.struct((r * F.col("guests") + v).alias("part"), stays.alias("stays"), visits.alias("visits"))
    stays = F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda v: role(home, v, F.lit(True), F.col("outside") & (v == guest)))
    visits = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda r: F.col("outside") & (r != home)), lambda r: role(r, guest, F.lit(False), F.lit(True)))
    rows = rows.withColumn("role", F.explode(F.concat(stays, visits))).select("key", "id", "component", "sign", "role.*")
    sets = texts.mapInArrow(_shingles, "id long, shingles binary").dropDuplicates(["id", "shingles"])
    rows = rows.join(sets.hint("merge"), "id").select("key", "part", "id", "stays", "visits", "component", "sign", "shingles")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "id").mapInArrow(_join_up, "a long, b long").distinct()


def _merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """(id, component) of found with the components that the links more join, found again among the components alone."""
    root = lambda end: more.select("a", "b").join(found.select(F.col("id").alias(end), F.col("component").alias(f"{end}_root")), end, "left")
    ends = root("a").withColumn("a_root", F.coalesce("a_root", "a")).join(root("b").withColumn("b_root", F.coalesce("b_root", "b")), ["a", "b"])
    joined = components(shared_table(ends.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a != b").distinct()))
    joined = joined.select(F.col("id").alias("component"), F.col("component").alias("top"))
    alone = joined.select(F.col("component").alias("id"), "component").join(found, "id", "left_anti")  # had no link before
    every = found.select("id", "component").union(alone)
    return shared_table(spread_join(every, joined, "component", hot_keys(every, "component"), "id").select("id", F.coalesce("top", "component").alias("component")))


def _shared_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that rows of one doc_id belong to."""
    several = known.groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("doc_id")
    rows = known.join(several, "doc_id", "left_semi").select("doc_id", "class").distinct().join(classes.select("class", "id"), "class")
    first = rows.groupBy("doc_id").agg(F.min("id").alias("a"))
    return rows.join(first, "doc_id").select("a", F.col("id").alias("b")).where("a != b").distinct()


def near_duplicates(docs: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = shared_table(docs.select("doc_id", "text").mapInArrow(_describe, f"doc_id {kind}, size long, class binary, minima binary"))
    known = described.where("doc_id is not null and size > 0")
    classes = known.groupBy("class").agg(F.min_by(F.struct(F.col("doc_id").cast("long").alias("id"), F.col("size").cast("int").alias("size"), "minima"), "doc_id").alias("first"))
    classes = shared_table(classes.select("class", "first.*"))
    leaders = classes.select("id", "size", "minima")
    crowded = crowded_buckets(leaders, per_part)
    if crowded.count() <= BROADCAST_ROWS:
        crowded = F.broadcast(crowded)
    rows = leaders.mapInArrow(_spread, _ROWS_DDL).join(crowded, "key", "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("n") / per_part), F.lit(1))).cast("int")).select("key", "part", "id", "size", "sign", F.col("n").isNotNull().alias("cut"))
    met = shared_table(rows.repartition("key", "part").sortWithinPartitions("key", "part", "id").mapInArrow(_meet, _MET_DDL))
    links = shared_table(met.where("b is not null").select("a", "b").distinct())
    members = met.where("b is null").select("key", F.col("a").alias("id"), "size", "sign")
    # the members of an open bucket that have a likely partner are in links, unless their bucket lies in parts
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).union(members.join(crowded, "key").select("id")).distinct()
    texts = shared_table(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ends.hint("merge"), "id", "left_semi"))
    confirmed = shared_table(_confirmed(texts, links).union(_shared_ids(known, classes)))
    found = components(confirmed)
    more = shared_table(_joined_up(texts, members, found, per_part))
    if more.limit(1).count():
        found = _merged(found, more)
    member = shared_table(classes.select("class", "id").join(found, "id", "left").select("class", F.coalesce("component", "id").alias("component_id")))
    out = spread_join(described.drop("minima"), member, "class", hot_keys(described, "class"), "doc_id")
    out = out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).cast(kind).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, without those whose component has a smaller doc_id."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS k FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.b, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id
"""
