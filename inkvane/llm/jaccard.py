"""N-gram Jaccard join with Bayesian pruning of candidates.

A document is the set of its shingles, ``SHINGLE`` consecutive words (runs of bytes other than ASCII white space, as they
are); two documents are linked if their sets' Jaccard similarity is at least the threshold.

1. Documents with equal sets form a class, stood for by its smallest doc_id, so exact copies cost one row.
2. Each class has ``BANDS * ROWS`` MinHash values. Classes that agree on a band are candidates: in each batch, and then
   over all batches, a member is tied to the first member of its bucket, so a bucket of m gives m - 1 edges, never pairs,
   and a batch sends one entry for a bucket however hot. At the threshold of 0.8 a pair shares no band with probability (1 - 0.8**4)**25 = 2e-6.
3. Inside each candidate group, MinHash values are compared in steps of ``STEP``; after n values with m agreements, the
   posterior probability (uniform prior) that the similarity reaches the threshold is P(Bin(n + 1, t) <= m), and a pair
   is dropped where that falls below ``TOLERANCE``. What is left splits the groups into smaller ones.
4. Inside those, every pair is verified exactly from the documents' shingles (intersection sizes as block products).

Groups of up to ``TILE`` classes (``TEXT_TILE`` where texts are compared) are bundled many to a task; larger ones are dealt
into blocks, a task for each pair of blocks. Tasks return a row per class (links, and the smallest linked class), never pairs.

Documents of fewer than ``SHINGLE`` words have one shingle, all their words; a document without words (null or white
space) has none and links with nothing, as does one without doc_id. Rows that repeat a doc_id count as documents of
their own: classes are numbered, and rows are told apart by doc_id and a hash of the text. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkvane.llm.common import arrow_bytes, components, cut, read
from inkvane.llm.hashing import BASES, mix, rolled, word_hashes
from inkvane.llm.vectors import Groups

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 4
STEP, TOLERANCE = 16, 1e-6
TILE, TEXT_TILE, BUNDLE = 2048, 1024, 1000
BUCKET_PAIRS = 250_000
_MULTIPLIERS = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))[:, None]


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending."""
    words = word_hashes(text)[:, 0]
    if not len(words):
        return words
    out = np.sort(rolled(words, size, BASES[0]) if len(words) >= size else rolled(words, len(words), BASES[0]) + np.uint64(len(words)))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values (upper 32 bits)."""
    out = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(out, (found[None, at : at + 4096] * _MULTIPLIERS).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def class_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest agreements among n MinHash values that leave a posterior of at least tolerance."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("binary"))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, h, key, n, sig) of every document that has words and a doc_id."""
    arrow_bytes(docs.sparkSession)

    names = ["doc_id", "h", "key", "n", "sig"]

    def describe(batches):
        for batch in batches:
            use, keys, sizes, sigs = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found = shingles(text.as_py())
                if len(found):
                    use.append(i)
                    keys.append(class_key(found))
                    sizes.append(len(found))
                    sigs.append(signature(found).tobytes())
            at = pa.array(use, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), text_hash().alias("h"))
    return rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") > 0)).mapInArrow(describe, "doc_id long, h long, key binary, n long, sig binary")


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of some edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for ends in (left, right, label[left], label[right]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def banded(classes: DataFrame) -> DataFrame:
    """Candidate edges (a, b), a >= b, between classes (rep, sig) that share a band.

    Pairs of band hash and class travel packed, in buckets of the hash's range; so do edges, in buckets of a hash of
    a, where they are contracted to one for each node.
    """
    spread = max(1, classes.count() * BANDS // BUCKET_PAIRS)
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])

    def packed(kind: int, bucket: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        bucket, x, y = bucket[order], x[order], y[order]
        first = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else []
        ends = np.append(first[1:], len(bucket)) if len(bucket) else []
        rows = [(kind, int(bucket[s]), x[s:e].tobytes(), y[s:e].tobytes()) for s, e in zip(first, ends, strict=True)]
        return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(schema.names)}, schema=schema)

    def tied(a: np.ndarray, hub: np.ndarray) -> pa.RecordBatch:
        """Edges from members to other classes, once each, by bucket of the member."""
        use = a != hub
        pairs = np.unique(np.column_stack([a[use], hub[use]]), axis=0)
        a, hub = pairs[:, 0].copy(), pairs[:, 1].copy()
        return packed(1, (mix(a.view(np.uint64)) % np.uint64(spread)).astype(np.int64), a, hub)

    def hubs(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sorted pairs, where each hash begins, and each pair's first owner."""
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h, owner, first, np.repeat(owner[first], np.diff(np.append(first, len(h))))

    def buckets(batches):
        for batch in batches:
            reps = batch.column(0).to_numpy()
            if not len(reps):
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(reps), -1).astype(np.uint64)
            h = np.zeros((len(reps), BANDS), np.uint64)
            for r in range(ROWS):
                h = mix(h * np.uint64(0xD1342543DE82EF95) + sig[:, r::ROWS][:, :BANDS] + np.uint64(1))
            h = mix(h + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).ravel()
            h, owner, first, hub = hubs(h, np.repeat(reps, BANDS))
            yield packed(0, (h[first] % np.uint64(spread)).astype(np.int64), h[first], owner[first])
            yield tied(owner, hub)

    def meet(key, table):
        if key[0].as_py() == 1:
            return table
        h, owner = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("x", np.uint64), ("y", np.int64)))
        _, owner, _, hub = hubs(h, owner)
        return pa.Table.from_batches([tied(owner, hub)])

    def contract(key, table):
        a, b = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("x", "y"))
        nodes, root = local_components(a, b)
        return pa.table({"a": nodes[nodes != root], "b": root[nodes != root]})

    kind = "kind int, bucket long, x binary, y binary"
    edges = classes.select("rep", "sig").mapInArrow(buckets, kind).groupBy("kind", "bucket").applyInArrow(meet, kind)
    return edges.where("kind = 1").groupBy("bucket").applyInArrow(contract, "a long, b long")


def survivors(sig_a, n_a, sig_b, n_b, threshold: float, needs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose MinHash values, compared step by step, keep the threshold likely enough."""
    n, need = needs[0]
    same = np.zeros((len(sig_a), len(sig_b)), np.uint8)
    for c in range(n):
        same += sig_a[:, c, None] == sig_b[None, :, c]
    low, high = np.minimum(n_a[:, None], n_b[None, :]), np.maximum(n_a[:, None], n_b[None, :])
    i, j = np.nonzero((same >= need) & (low >= threshold * high - 1e-9))
    got = same[i, j].astype(np.int64)
    for (before, _), (n, need) in zip(needs, needs[1:], strict=False):
        if not len(i):
            break
        for at in range(0, len(i), 1 << 18):
            part = slice(at, at + (1 << 18))
            got[part] += (sig_a[i[part], before:n] == sig_b[j[part], before:n]).sum(axis=1)
        alive = got >= need
        i, j, got = i[alive], j[alive], got[alive]
    return i, j


def pruned_groups(reps, sig, n, side, threshold: float, tolerance: float) -> np.ndarray:
    """For each class, the smallest class of its group after pruning. side: of two blocks, or all 0 for one."""
    total = sig.shape[1]
    needs = [(k, least_matches(k, threshold, tolerance)) for k in [*range(STEP, total, STEP), total]]
    groups = Groups(len(reps))
    left = np.flatnonzero(side == side[0])
    right = left if len(left) == len(reps) else np.flatnonzero(side != side[0])
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        cols = right[right > rows[0]] if right is left else right
        if not len(cols):
            continue
        i, j = survivors(sig[rows], n[rows], sig[cols], n[cols], threshold, needs)
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for s, e in zip(starts, np.append(starts, len(i))[1:], strict=True):  # none may survive between two blocks
            groups.join(int(rows[i[s]]), cols[j[s:e]])
    least = np.full(len(reps), np.iinfo(np.int64).max)
    np.minimum.at(least, groups.label, reps)
    return least[groups.label]


def exact_links(reps, sets: list[np.ndarray], copies, side, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each class to documents of others, and the smallest class of its group, from exact similarities."""
    n = np.array([len(s) for s in sets], np.int64)
    left = np.flatnonzero(side == side[0])
    right = left if len(left) == len(reps) else np.flatnonzero(side != side[0])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    values, place, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen > 1
    column = np.cumsum(shared) - 1
    use = shared[place]
    owner, place = owner[use], column[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = max(64, min(4096, (1 << 22) // len(sets)))
    common = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(place, np.arange(0, int(shared.sum()) + width, width))
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], place[a:b] - k * width] = 1
        common += block[left] @ block[right].T
    count, groups = np.zeros(len(reps), np.int64), Groups(len(reps))
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        hit = common[at : at + 128].astype(np.float64) * (1 + threshold) >= threshold * (n[rows][:, None] + n[right][None, :]) - 1e-9
        if right is left:
            hit[np.arange(len(rows)), at + np.arange(len(rows))] = False
        else:
            count[right] += hit.T @ copies[rows]
        count[rows] += hit @ copies[right]
        for r in np.flatnonzero(hit.any(axis=1)):
            groups.join(int(rows[r]), right[hit[r]])
    least = np.full(len(reps), np.iinfo(np.int64).max)
    np.minimum.at(least, groups.label, reps)
    return count, least[groups.label]


def tiles(members: DataFrame, tile: int, bundle: int) -> DataFrame:
    """members (rep, component, ...) dealt into tasks (task, i, j, side): small components bundled, large ones tiled."""
    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    total = members.count()
    bundles = max(1, total // bundle)
    rows = members.join(sizes, "component").where("m > 1")
    blocks = F.ceil(F.col("m") / tile).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("side", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(bundles)))
    return rows.withColumns({"task": task, "i": F.least("side", "o"), "j": F.greatest("side", "o")}).drop("o", "m", "blocks")


def _by_component(table: pa.Table):
    """Rows of each component of a task's table."""
    comp = table.column("component").to_numpy()
    order = np.argsort(comp, kind="stable")
    edges = np.flatnonzero(np.diff(comp[order], prepend=comp[order][0] - 1))
    return np.split(order, edges[1:])


def linked_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, tile: int = TILE, bundle: int = BUNDLE, text_tile: int = TEXT_TILE) -> tuple[DataFrame, DataFrame]:
    """(documents with their class, links of classes): (doc_id, h, node, rep, copies) and (node, rep, others, component, first).

    node: a class's number; rep: its smallest doc_id; first: the smallest (doc_id, h) of its group, component that doc_id.
    """
    per_doc = cut(described(docs))
    classes = per_doc.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # A class's number is of the written rows, so it stays.
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    numbered = classes.select(F.col("node").alias("rep"), "n", "sig")
    groups = components(banded(numbered)).select(F.col("node").alias("rep"), "component")

    def prune(key, table):
        same = key[1].as_py() == key[2].as_py()
        reps, side, n = (table.column(c).to_numpy() for c in ("rep", "side", "n"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(reps), -1)
        root = reps.copy()
        for at in _by_component(table):
            if len(at) > 1 and (same or len(np.unique(side[at])) > 1):
                root[at] = pruned_groups(reps[at], sig[at], n[at], np.zeros(len(at), int) if same else side[at], threshold, tolerance)
        return pa.table({"a": reps, "b": root})

    near = tiles(numbered.join(groups, "rep"), tile, bundle)
    tied = near.groupBy("task", "i", "j").applyInArrow(prune, "a long, b long")
    fine = components(tied).select(F.col("node").alias("rep"), "component")

    def verify(key, table):
        same = key[1].as_py() == key[2].as_py()
        sets = [shingles(t.as_py()) for t in table.column("text")]
        keys = table.column("key").to_pylist()
        right = np.array([class_key(s) == k for s, k in zip(sets, keys, strict=True)], bool)
        reps, side, copies = (table.column(c).to_numpy() for c in ("rep", "side", "copies"))
        out = []
        for at in _by_component(table):
            at = at[right[at]]
            at = at[np.unique(np.array([keys[k] for k in at], object), return_index=True)[1]] if len(at) else at
            if len(at) > 1 and (same or len(np.unique(side[at])) > 1):
                count, root = exact_links(reps[at], [sets[k] for k in at], copies[at], np.zeros(len(at), int) if same else side[at], threshold)
                some = (count > 0) | (root != reps[at])
                out.append((reps[at][some], count[some], root[some]))
        cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
        return pa.table({"rep": cols[0], "others": cols[1], "root": cols[2]})

    members = cut(classes.select(F.col("node").alias("rep"), F.col("least.doc_id").alias("doc_id"), F.col("least.h").alias("h"), "key", "copies").join(fine, "rep"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), text_hash().alias("h"))
    placed = tiles(members, min(tile, text_tile), bundle)
    checked = texts.join(placed.hint("shuffle_hash"), ["doc_id", "h"]).groupBy("task", "i", "j").applyInArrow(verify, "rep long, others long, root long")
    checked = cut(checked)
    ends = components(checked.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select("node", F.col("component").alias("end"))
    counts = checked.groupBy(F.col("rep").alias("node")).agg(F.sum("others").alias("others"))
    linked = counts.join(ends, "node").join(classes.select("node", "least"), "node")
    firsts = linked.groupBy("end").agg(F.min("least").alias("first"))
    links = linked.join(firsts, "end").select("node", F.col("least.doc_id").alias("rep"), "others", F.col("first.doc_id").alias("component"), "first")
    docs_classes = per_doc.select("doc_id", "h", "key").join(classes.select("key", "node", "least", F.col("least.doc_id").alias("rep"), "copies"), "key")
    return docs_classes, links


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_links, component_id, kept of every document."""
    found, links = linked_classes(docs, threshold)
    out = found.join(links.drop("rep"), "node", "left").select("doc_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("compared"))
    rest = ids.where("compared is null or not compared").select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group of linked rows: the one of the smallest doc_id. Rows without doc_id come last."""
    row = ["_doc", "_h"]
    marked = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "_h": text_hash()})
    found, links = linked_classes(marked.select(F.col("_doc").alias("doc_id"), "text"), threshold)
    found = found.withColumnsRenamed({"doc_id": "_doc", "h": "_h"})
    first = F.coalesce("first", "least")
    gone = found.join(links.drop("rep"), "node", "left").where((F.col("_doc") != first["doc_id"]) | (F.col("_h") != first["h"])).select(*row).distinct()
    kept = marked.join(gone.hint("shuffle_hash"), row, "left_anti")
    twice = cut(found.groupBy(*row).count().where("count > 1").select(*row))
    if twice.limit(1).count():
        kept = kept.join(twice, row, "left_anti").unionByName(kept.join(twice, row, "left_semi").dropDuplicates(row))
    return kept.select(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
