"""Near-duplicate embeddings by lattice hashing.

Vectors are normalised, projected at random to 8 dimensions in several tables,
and decoded to the nearest point of the E8 lattice, whose cells are rounder
than cubes.  Each vector is filed under its cell in each table and looks into
that cell and into the neighbouring ones that its projection is nearest to
(each of the other lattice coset's best point and of single and paired
coordinate steps).  What meets in a cell is verified by cosine in double
precision, within the same label only.

Linked pairs never leave the task that finds them.  It sends out a count of
links for each vector and as many links as join the group's components.  A pair
that meets in several cells is counted in the first of them alone: the tables
and cells in which the two meet follow from the vectors, whose projections are
computed in one order of additions whatever else is in the batch.

Equal vectors of a label form a class with its smallest id, and only classes
meet; a class's members are linked with each other, so a vector that a third
of all rows share costs no more than one.  The residents of cells are counted
first; a cell of more than ``limit`` is cut into parts of its residents and
parts of its visitors, and each pair of parts is a group of its own, so no
group grows with a crowded cell.  (As n_links counts every link, a cell whose
n vectors are all alike but not equal takes n * n comparisons.)

Defined results: a vector that is null, zero, or holds a null or non-finite
component, and a vector without label, has no links and is its own component;
vectors of another length than most meet only their like; a row with null
vec_id has no links and a null component and is kept; rows that share a vec_id
are one node, and n_links counts rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import hot_keys, shared_table, spread_join
from .textcols import mix64

DIMENSIONS, TABLES, PROBES = 8, 4, 6
COSINE = 0.98
#: Crowded cells are broadcast up to this number, beyond it they are joined by their key.
BROADCAST_ROWS = 200_000
#: Lattice units that two vectors at the limit are apart after projection, on average.
REACH = 0.45


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = near.sum(1) % 2 != 0
    worst = np.abs(off).argmax(1)
    at = np.arange(len(x))
    near[at[odd], worst[odd]] += np.where(off[at[odd], worst[odd]] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest lattice point, nearest point of the other coset), both doubled to be whole numbers."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    first = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(first[:, None], 2 * a, 2 * b), np.where(first[:, None], 2 * b, 2 * a)


#: The 240 shortest vectors of E8, doubled: neighbours of a cell.
def _roots() -> np.ndarray:
    out = []
    for i in range(8):
        for j in range(i):
            for s in (2, -2):
                for t in (2, -2):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    out.append(v)
    for k in range(256):
        v = np.array([1 if k >> i & 1 else -1 for i in range(8)], float)
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


ROOTS = _roots()


def _keys(points: np.ndarray, table: int, label: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit key of each cell; vectors of another length have cells of their own."""
    with np.errstate(over="ignore"):
        h = mix64(mix64(label.astype(np.int64).view(np.uint64) * np.uint64(1000003) + np.uint64(table)) ^ np.uint64(length))
        for k in range(points.shape[1]):
            h = mix64(h ^ points[:, k].astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def _projections(dimensions: int, seed: int = 10) -> list[np.ndarray]:
    random = np.random.default_rng([seed, dimensions])
    apart = np.sqrt(2 - 2 * COSINE) * np.sqrt(DIMENSIONS / dimensions)
    return [np.linalg.qr(random.normal(size=(dimensions, min(DIMENSIONS, dimensions))))[0] * (REACH / apart) for _ in range(TABLES)]


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision, None for those that link with nothing."""
    out: list = []
    for x in column.to_pylist():
        v = None if x is None or any(c is None for c in x) else np.array(x, float)
        norm = 0.0 if v is None or not len(v) else float(np.linalg.norm(v))
        out.append(v / norm if norm > 0 and np.isfinite(norm) else None)
    return out


#: What a vector is in a group: it looks in, it lives there and looks at the others, or it only lives there (in parts of a crowded cell).
VISITOR, MEMBER, RESIDENT = 0, 1, 2
_FILED_DDL = "key long, id long, own boolean, tab int, members long, vector binary"


def _packed(values: list[float]) -> bytes:
    """Components as single precision where that is exact, else as double."""
    double = np.array(values, "<f8")
    with np.errstate(over="ignore"):
        single = double.astype("<f4")
    return b"f" + single.tobytes() if (single == double).all() else b"d" + double.tobytes()


def _unit(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, "<f4" if raw[:1] == b"f" else "<f8", offset=1).astype(float)
    return x / np.linalg.norm(x)


def _projected(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """x @ matrix, padded to 8 dimensions, added up in the same order for every row whatever the other rows are."""
    y = np.zeros((len(x), DIMENSIONS))
    for k in range(x.shape[1]):
        y[:, : matrix.shape[1]] += x[:, k : k + 1] * matrix[k]
    return y


def _around(y: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The neighbouring cells (row, PROBES, 8) that each projection is nearest to."""
    out = np.empty((len(y), PROBES, DIMENSIONS))
    for a in range(0, len(y), 512):
        around = cell[a : a + 512, None, :] + ROOTS[None, :, :]
        near = np.argpartition(((around / 2 - y[a : a + 512, None, :]) ** 2).sum(2), PROBES, 1)[:, :PROBES]
        out[a : a + 512] = np.take_along_axis(around, near[:, :, None], 1)
    return out


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(rows, projections, cells, table, length) of the usable vectors of a batch (id, label, embedding, ..), by length and table."""
    vectors = _vectors(batch.column(2))
    for size in sorted({len(v) for v in vectors if v is not None}):
        some = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == size])
        x = np.stack([vectors[i] for i in some])
        for t, matrix in enumerate(_projections(size)):
            y = _projected(x, matrix)
            yield some, y, nearest_e8(y)[0], t, size


def _residents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, embedding, ..) to the keys of the cells that hold each vector."""
    for batch in batches:
        labels = batch.column(1).to_numpy()
        for some, _, cell, t, size in _cells(batch):
            yield pa.RecordBatch.from_arrays([pa.array(_keys(cell, t, labels[some], size))], names=["key"])


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, embedding, members) to residents of their cells and visitors of neighbouring ones."""
    for batch in batches:
        ids, labels, members = (batch.column(k).to_numpy() for k in (0, 1, 3))
        for some, y, cell, t, size in _cells(batch):
            around = _around(y, cell)
            keys = np.concatenate([_keys(cell, t, labels[some], size), *[_keys(around[:, k], t, labels[some], size) for k in range(PROBES)]])
            of = np.tile(np.arange(len(some)), PROBES + 1)
            raw = pa.array([_packed(batch.column(2)[int(i)].as_py()) for i in some], pa.binary())
            columns = [pa.array(keys), pa.array(ids[some][of]), pa.array(np.arange(len(of)) < len(some)), pa.array(np.full(len(of), t, np.int32)), pa.array(members[some][of]), raw.take(pa.array(of))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "own", "tab", "members", "vector"])


def _first_meetings(x: np.ndarray, ids: np.ndarray, tab: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs (p lives in this cell of table tab, q looks in) meet here first: in no table before, and in this
    table, if each looks into the other's cell, where the one with the smaller id lives."""
    used, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    i, j = at[: len(p)], at[len(p) :]
    first = np.ones(len(p), bool)
    label = np.zeros(len(used), np.int64)
    for t, matrix in enumerate(_projections(x.shape[1])[: tab + 1]):
        y = _projected(x[used], matrix)
        cell = nearest_e8(y)[0]
        around = _around(y, cell)
        own = _keys(cell, t, label, x.shape[1])
        near = np.stack([_keys(around[:, k], t, label, x.shape[1]) for k in range(PROBES)], 1)
        together = own[i] == own[j]
        i_looks, j_looks = (near[i] == own[j][:, None]).any(1), (near[j] == own[i][:, None]).any(1)
        if t < tab:
            first &= ~(together | i_looks | j_looks)
        else:
            first &= (ids[p] < ids[q]) | ~(together | i_looks)
    return first


def _verified(ids: np.ndarray, role: np.ndarray, members: np.ndarray, x: np.ndarray, tab: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links that join the components of a group, links of each row that are counted here)."""
    lives, looks = np.flatnonzero(role != VISITOR), np.flatnonzero(role != RESIDENT)
    counts = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    links: list[tuple[int, int]] = []
    for a in range(0, len(looks), 256):
        q, p = np.nonzero(x[looks[a : a + 256]] @ x[lives].T >= COSINE - 1e-9)
        q, p = looks[a + q], lives[p]
        q, p = q[ids[q] != ids[p]], p[ids[q] != ids[p]]
        for k in range(0, len(q), 1 << 16):  # the cosine again, added up alike wherever the two meet
            own, other = q[k : k + (1 << 16)], p[k : k + (1 << 16)]
            fits = (x[own] * x[other]).sum(1) >= COSINE
            own, other = own[fits], other[fits]
            if not len(own):
                continue
            for i, j in zip(own[root[own] != root[other]].tolist(), other[root[own] != root[other]].tolist(), strict=True):
                if root[i] != root[j]:
                    links.append((int(ids[i]), int(ids[j])))
                    root[root == root[j]] = root[i]
            here = _first_meetings(x, ids, tab, other, own)
            np.add.at(counts, own[here], members[other[here]])
            np.add.at(counts, other[here], members[own[here]])
    return links, counts


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filed rows (key, part, id, role, tab, members, vector) in the order of key and part to links (a, b, null) and counts of links (a, null, n)."""

    def done(table: pa.Table) -> pa.RecordBatch:
        keys, parts, ids, role, tab, members = (table[c].to_numpy() for c in ("key", "part", "id", "role", "tab", "members"))
        raw = table["vector"]
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])))
        ends = np.append(starts[1:], len(keys))
        links: list[tuple[int, int]] = []
        counted: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        residents = np.add.reduceat(role != VISITOR, starts)
        for a, b, n in zip(starts.tolist(), ends.tolist(), residents.tolist(), strict=True):
            if not n or b - a == 1:
                continue
            vectors = [_unit(v) for v in raw.slice(a, b - a).to_pylist()]
            lengths = np.array([len(v) for v in vectors])
            for length in np.unique(lengths).tolist():  # nearly always one; keys of other lengths are equal only by chance
                of = np.flatnonzero(lengths == length)
                found, counts = _verified(ids[a + of], role[a + of], members[a + of], np.stack([vectors[i] for i in of]), int(tab[a]))
                links += found
                counted.append((ids[a + of][counts > 0], counts[counts > 0]))
        pairs = np.array(links, np.int64).reshape(-1, 2)
        a, n = (np.concatenate(c) for c in zip(*counted, strict=True))
        columns = [
            pa.array(np.concatenate([pairs.min(1), a]) if len(pairs) else a),
            pa.concat_arrays([pa.array(pairs.max(1)) if len(pairs) else pa.nulls(0, pa.int64()), pa.nulls(len(a), pa.int64())]),
            pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(n)]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch], schema=batch.schema)
        table = table if rest is None else pa.concat_tables([rest, table])
        keys, parts = table["key"].to_numpy(), table["part"].to_numpy()
        cut = int(np.argmax((keys == keys[-1]) & (parts == parts[-1])))
        rest = table.slice(cut)
        if cut:
            yield done(table.slice(0, cut))
    if rest is not None and len(rest):
        yield done(rest)


def linked_vectors(vectors: DataFrame, limit: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label)."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    value = F.col("embedding")
    double = F.transform(value, lambda x: x.cast("double"))
    norm = F.aggregate(double, F.lit(0.0).cast("double"), lambda s, x: s + x * x)
    fit = value.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(value, lambda x: x.isNull() | F.isnan(x.cast("double"))) & (norm > 0) & (norm < float("inf"))
    # -0.0 and 0.0 are the same number
    canon = F.transform(double, lambda x: x + F.lit(0.0))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.when(fit, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.to_json(canon)), 256)).alias("class"), value.alias("embedding"))
    rows = shared_table(rows)
    known = rows.where("class is not null")
    first = F.min_by(F.struct(F.col("vec_id").cast("long").alias("id"), "label", "embedding"), "vec_id").alias("first")
    classes = shared_table(known.groupBy("class").agg(first, F.count("*").alias("members")).select("class", "first.*", "members"))
    leaders = classes.select("id", "label", "embedding", "members")
    crowded = leaders.mapInArrow(_residents, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    crowded = shared_table(crowded)  # at most TABLES / limit of the number of classes
    if crowded.count() <= BROADCAST_ROWS:
        crowded = F.broadcast(crowded)
    filed = leaders.mapInArrow(_file, _FILED_DDL).join(crowded, "key", "left")
    parts = F.coalesce(F.ceil(F.col("n") / limit), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("id"), parts).cast("int")
    every = F.sequence(F.lit(0), parts - 1)
    group = lambda r, v, role: F.struct((r * parts + v).alias("part"), F.lit(role).alias("role"))
    # part r of the residents meets part v of the visitors in the group r * parts + v; residents visit too
    resident, visitor = F.transform(every, lambda v: group(mine, v, RESIDENT)), F.transform(every, lambda r: group(r, mine, VISITOR))
    roles = F.when(F.col("own") & (parts == 1), F.array(group(F.lit(0), F.lit(0), MEMBER))).when(F.col("own"), F.concat(resident, visitor)).otherwise(visitor)
    filed = filed.withColumn("in", F.explode(roles)).select("key", "in.part", "id", "in.role", "tab", "members", "vector")
    found = filed.repartition("key", "part").sortWithinPartitions("key", "part", "id").mapInArrow(_verify, "a long, b long, n long")
    found = shared_table(found.groupBy("a", "b").agg(F.sum("n").alias("n")))
    component = components(found.where("b is not null").select("a", "b"))
    beyond = found.where("b is null").select(F.col("a").alias("id"), F.col("n").alias("beyond"))
    member = classes.select("class", "id", "members").join(component, "id", "left").join(beyond, "id", "left")
    member = member.select("class", (F.col("members") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    rows = rows.select("vec_id", "class")
    out = spread_join(rows, shared_table(member), "class", hot_keys(rows, "class"), "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id")).cast(kind).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_lattice(spark, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(b, v.vec_id)) AS component_id, v.vec_id <= coalesce(b, v.vec_id) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = v.vec_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = v.vec_id
"""
