"""Embedding near-dedup: spherical k-means cells, blocked cosine products within them, one vector of each group kept.

Centres are fitted on at most ``FIT_ROWS`` vectors (those with the smallest hash of vec_id); every vector is then
assigned. A vector u at home in cell a can be linked to v only if v lies near a: v joins its home cell and, as a guest,
each cell whose boundary with its home is within ``margin``. The default margin is the chord sqrt(2 - 2t) of the
threshold t, by which no link is lost, whatever the vectors' spread. How many cells are made, one to ``MOST_CELLS``, is
the choice of least work by the memberships counted on the fitted sample: where the vectors fill many dimensions nearly
every cell is a neighbour, and one cell in blocks is the least. A smaller ``margin`` is faster and loses links.

Each vector's links are counted once, in its home cell. Cells of more than ``TILE`` vectors are dealt into blocks by a
hash of vec_id, and each pair of blocks is one task, so no cell is gathered in one place. Cosines are double precision.
A task returns links per vector and one edge to the smallest vec_id of its local group, never pairs.

Null, zero or non-finite vectors, and rows without vec_id, link with nothing. Vectors of other lengths than the most
frequent one are compared among their own length, in a single cell. Repeated rows of a vec_id give one row: they count
as vectors for others and among themselves. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkvane.llm.common import arrow_bytes, components, cut, read

THRESHOLD = 0.95
FIT_ROWS = 20_000
CELL_ROWS, MOST_CELLS = 500, 1024
TILE = 16_384
STEP = 512
#: Comparisons of two vectors that take as long as sending one to a task.
SENT = 1000


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of usable vectors (rows of x) and these as unit rows."""
    x = np.asarray(x, float)
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return np.flatnonzero(good), x[good] / norm[good, None]


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centres of unit vectors by cosine; an emptied centre moves to the vector that is worst served."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = x @ centres.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        empty = np.flatnonzero(size < 1e-12)
        if len(empty):
            worst = np.argsort(near[np.arange(len(x)), home])[: len(empty)]
            sums[empty[: len(worst)]], size[empty[: len(worst)]] = x[worst], 1.0
        centres = sums / np.maximum(size, 1e-12)[:, None]
    return centres


class Cells:
    def __init__(self, centres: np.ndarray, margin: float):
        self.centres, self.margin = centres, margin
        self.apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)) if len(centres) else None
        self.dims = centres.shape[1] if len(centres) else 0

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, at home) for every cell that a row belongs to."""
        if x.shape[1] != self.dims:
            n = np.arange(len(x))
            return n, np.full(len(x), -x.shape[1]), np.ones(len(x), bool)
        near = x @ self.centres.T
        home = near.argmax(axis=1)
        best = near[np.arange(len(x)), home]
        row, cell = np.nonzero(best[:, None] - near <= self.margin * self.apart[home] + 1e-12)
        return row, cell, cell == home[row]


def fitted(vectors: DataFrame, threshold: float, margin: float | None = None) -> Cells:
    """Cells for vectors (vec_id, embedding)."""
    ok = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    lengths = ok.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return Cells(np.zeros((0, 0)), 0.0)
    dims, n = lengths[0]
    some = ok.where(F.size("embedding") == dims).orderBy(F.xxhash64(F.lit("cells"), "vec_id"), "vec_id").limit(FIT_ROWS).select("embedding")
    rows = [r[0] for r in some.collect() if None not in r[0]]
    _, x = unit_rows(np.array(rows, float).reshape(len(rows), dims))
    most = min(max(1, n // CELL_ROWS), MOST_CELLS, len(x))
    if most == 0:
        return Cells(np.zeros((0, 0)), 0.0)
    margin = (2 - 2 * threshold) ** 0.5 if margin is None else margin
    sizes = sorted({most, *(4**i for i in range(6) if 4**i < most)})
    return min((Cells(k_means(x, k), margin) for k in sizes), key=lambda cells: work(cells, x, n))


def work(cells: Cells, x: np.ndarray, n: int) -> float:
    """Comparisons, and vectors sent as comparisons, that n vectors like the sample x make."""
    k = len(cells.centres)
    here, home = np.zeros(k), np.zeros(k)
    for at in range(0, len(x), 1000):
        _, cell, own = cells.of(x[at : at + 1000])
        here += np.bincount(cell, minlength=k)
        home += np.bincount(cell[own], minlength=k)
    here, home = here * n / len(x), home * n / len(x)
    return float((home * here + SENT * here * np.ceil(here / TILE)).sum())


def members(batches, cells: Cells, kind=float):
    """(vec_ids, vectors, row, cell, at home) of each batch and each length of vectors."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        use = ~(ids.is_null().to_numpy(zero_copy_only=False) | lists.is_null().to_numpy(zero_copy_only=False))
        offsets, values = lists.offsets.to_numpy(), lists.values
        flat, empty = values.to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)
        sizes = np.where(use, np.diff(offsets), 0)
        ids = ids.fill_null(0).to_numpy()
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == size)
            at = offsets[rows][:, None] + np.arange(size)
            whole = ~empty[at].any(axis=1)
            rows, at = rows[whole], at[whole]
            own = flat[at].astype(kind)
            good, x = unit_rows(own)
            if len(good):
                yield (ids[rows[good]], own[good], *cells.of(x))


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return np.array([zlib.crc32(b"%d" % i) for i in ids.tolist()], np.int64) % blocks


class Groups:
    """Groups of local vectors, joined one row of links at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, row: int, others: np.ndarray) -> None:
        found = np.unique(np.append(self.label[others], self.label[row]))
        if len(found) > 1:
            self.label[np.isin(self.label, found[1:])] = found[0]


def linked(ids: np.ndarray, home: np.ndarray, side: np.ndarray, x: np.ndarray, same: bool, threshold: float):
    """Within a tile: links of each vector at home, and the smallest vec_id of each vector's local group."""
    order = np.lexsort((ids, side))
    ids, home, side, x = ids[order], home[order], side[order], x[order]
    split = len(ids) if same else int((side == side[0]).sum())
    left, right = np.arange(split), np.arange(split) if same else np.arange(split, len(ids))
    count, groups = np.zeros(len(ids), np.int64), Groups(len(ids))
    # A link of two guests is seen in their own cells. Of two blocks, those at home in the left one meet the right one,
    # then those at home in the right one the guests in the left one.
    turns = [(left[home[left]], right)] if same else [(left[home[left]], right), (right[home[right]], left[~home[left]])]
    for those, others in turns:
        for at in range(0, len(those), STEP):
            rows = those[at : at + STEP]
            hit = x[rows] @ x[others].T >= threshold
            if same:
                hit[np.arange(len(rows)), rows] = False
            count[rows] += hit.sum(axis=1)
            if not same:
                count[others] += hit.sum(axis=0)
            for r in np.flatnonzero(hit.any(axis=1)):
                groups.join(int(rows[r]), others[hit[r]])
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, groups.label, ids)
    return ids, np.where(home, count, 0), least[groups.label]


def links(vectors: DataFrame, cells: Cells, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n, root) from every tile in which a vector has a link."""
    arrow_bytes(vectors.sparkSession)

    def sizes(batches):
        for _, _, _, cell, _ in members(batches, cells):
            found, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_pydict({"cell": found.astype(np.int64), "n": n.astype(np.int64)})

    rows = vectors.select("vec_id", "embedding")
    counted = rows.mapInArrow(sizes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > tile).collect()
    blocks = {r[0]: -(-r[1] // tile) for r in counted}  # at most a row for each cell
    schema = pa.schema([("cell", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("ids", pa.binary()), ("home", pa.binary()), ("x", pa.binary())])

    # Vectors travel as they came, floats as floats, and are made unit vectors of doubles where they meet.
    kind = np.float32 if rows.schema["embedding"].dataType.elementType.typeName() == "float" else float

    def deal(batches):
        for ids, x, row, cell, home in members(batches, cells, kind):
            out = []
            order = np.argsort(cell, kind="stable")
            edges = np.flatnonzero(np.diff(cell[order], prepend=cell[order][0] - 1))
            for part in np.split(order, edges[1:]):
                c = int(cell[part[0]])
                nb = blocks.get(c, 1)
                own = block_of(ids[row[part]], nb) if nb > 1 else np.zeros(len(part), np.int64)
                for b in np.unique(own).tolist():
                    sel = part[own == b]
                    data = (b, ids[row[sel]].tobytes(), home[sel].tobytes(), x[row[sel]].tobytes())
                    out += [(c, min(b, o), max(b, o), *data) for o in range(nb)]
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(schema.names)}, schema=schema)

    def meet(key, table):
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
        home = np.frombuffer(b"".join(table.column("home").to_pylist()), bool)
        sizes = [len(v) // 8 for v in table.column("ids").to_pylist()]
        side = np.repeat(table.column("side").to_numpy(), sizes)
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), kind)
        x = unit(x.reshape(len(ids), -1))
        same = key[1].as_py() == key[2].as_py()
        if not same and len(np.unique(side)) < 2:
            ids, n, root = ids[:0], ids[:0], ids[:0]
        else:
            ids, n, root = linked(ids, home, side, x, same, threshold)
        use = (n > 0) | (root != ids)
        return pa.table({"vec_id": ids[use], "n": n[use], "root": root[use]})

    dealt = rows.mapInArrow(deal, "cell long, i int, j int, side int, ids binary, home binary, x binary")
    return dealt.groupBy("cell", "i", "j").applyInArrow(meet, "vec_id long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, margin: float | None = None, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vec_id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    found = cut(links(rows, fitted(rows, threshold, margin), threshold, tile))
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("vec_id"), F.col("component").alias("component_id"))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    out = rows.select("vec_id").distinct().join(counts, "vec_id", "left").join(groups, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
