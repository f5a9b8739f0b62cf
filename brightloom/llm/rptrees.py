"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Every node of a tree splits by a random direction at the median of its projections; vectors near the threshold go to both
sides. Vectors that share a leaf of any tree and a label are compared by cosine in double precision; pairs at the threshold
or above are links, and links are united into components. A pair that meets in several leaves counts in the first of them
only (each vector carries its leaves), so blocks return a number of links and one edge of a spanning forest for each
vector, never the pairs.

The upper levels are fitted on a bounded sample (SAMPLE vectors, stated), so what travels with the tasks has a fixed size; every
vector is indexed. Leaves that are still large are split further, in rounds, at medians computed over all their vectors. What
no split divides, such as large groups of copies, is compared whole, in pairs of blocks; equal vectors are one class before.
Vectors of a length that the sample missed share one leaf until it is split.

Defined results: vectors that are null, empty, zero, or hold nulls or non-finite components, and rows without a label, link
with nothing and are their own component; lengths that differ never link; rows that share a vec_id are the same node; a
null vec_id links with nothing. Other columns are dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved
from .components import components

SAMPLE = 20_000
TREES = 6
#: Vectors that a leaf has on average, and those from which a leaf is split again.
LEAF, LARGE = 1_000, 4_000
#: Rows of one block when a large leaf is compared whole.
BLOCK = 1_000
SEED = 20


def _spread(cosine: float, dim: int) -> float:
    """Half the spill: half a standard deviation of the projected difference of two unit vectors at this cosine."""
    return 0.5 * float(np.sqrt(max(2 - 2 * cosine, 1e-6) / max(dim, 1)))


def unit(rows) -> np.ndarray:
    """Rows of length 1, whatever their scale."""
    x = np.array(rows, np.float64)
    if len(x):
        x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Tree:
    """Nodes in arrays: direction, threshold, children (negative: leaf -k - 1)."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int, margin: float):
        r = np.random.default_rng(seed)
        self.margin, self.leaves = margin, 0
        self.direction: list[np.ndarray] = []
        self.threshold: list[float] = []
        self.child: list[list[int]] = []
        self.root = self._grow(sample, depth, r)

    def _grow(self, x: np.ndarray, depth: int, r) -> int:
        if depth == 0 or len(x) < 16:
            self.leaves += 1
            return -self.leaves
        d = r.standard_normal(x.shape[1])
        d /= np.sqrt(d @ d)
        p = x @ d
        cut = float(np.median(p))
        at = len(self.child)
        self.direction.append(d)
        self.threshold.append(cut)
        self.child.append([0, 0])
        self.child[at] = [self._grow(x[p < cut + self.margin], depth - 1, r), self._grow(x[p >= cut - self.margin], depth - 1, r)]
        return at

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each vector goes to."""
        rows, leaves = [], []
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, ids = todo.pop()
            if not len(ids):
                continue
            if node < 0:
                rows.append(ids)
                leaves.append(np.full(len(ids), -node - 1))
                continue
            p = x[ids] @ self.direction[node]
            todo.append((self.child[node][0], ids[p < self.threshold[node] + self.margin]))
            todo.append((self.child[node][1], ids[p >= self.threshold[node] - self.margin]))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, int), np.zeros(0, int))


_MEMBER = "leaf long, label string, node long, dim int"


def _matrix(column, dim: int) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _placed(trees: dict[int, list[Tree]]):
    """Rows for every leaf of every tree; leaf ids hold the tree."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in _MEMBER.split(", ")]
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                dims = part.column("dim").to_numpy()
                for dim in np.unique(dims):
                    ids = np.flatnonzero(dims == dim)
                    x = _matrix(part.column("v").take(pa.array(ids)), int(dim))
                    for t, tree in enumerate(trees.get(int(dim)) or [Tree(np.zeros((0, int(dim))), 0, SEED, 0.0)]):
                        rows, leaf = tree.place(x)
                        at = pa.array(ids[rows])
                        yield pa.RecordBatch.from_arrays([pa.array(t << 32 | leaf), part.column("label").take(at), part.column("node").take(at), part.column("dim").take(at)], names=names)

    return run


def _direction(leaf: int, dim: int) -> np.ndarray:
    d = np.random.default_rng([leaf & (2**63 - 1), 5]).standard_normal(dim)
    return d / np.sqrt(d @ d)


def _projected(batches):
    """Adds each row's projection on its leaf's own direction, in place of its vector."""
    import pyarrow as pa

    for batch in batches:
        leaf, dims = batch.column("leaf").to_numpy(), batch.column("dim").to_numpy()
        p = np.zeros(batch.num_rows)
        for key in {(int(a), int(b)) for a, b in zip(leaf, dims, strict=True)}:
            ids = np.flatnonzero((leaf == key[0]) & (dims == key[1]))
            p[ids] = _matrix(batch.column("v").take(pa.array(ids)), key[1]) @ _direction(*key)
        names = [x.split()[0] for x in _MEMBER.split(", ")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p)], names=[*names, "p"])


_KEYS = ["leaf", "label", "dim", "i", "j"]
_FOUND = "node long, root long, n long"


def _met_before(leaf: int, owner: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Which of n vectors lie in which leaves before this one, of those leaves that two of them share."""
    early = ids < leaf
    owner, ids = owner[early], ids[early]
    kinds, at, many = np.unique(ids, return_inverse=True, return_counts=True)
    column = np.cumsum(many > 1) - 1
    keep = many[at] > 1
    out = np.zeros((n, int((many > 1).sum())), np.float32)
    out[owner[keep], column[at[keep]]] = 1
    return out


def compared(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, before: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray], cosine: float):
    """Links between unit rows x and y of nodes p and q: (copies linked to each of p, of q, by pairs that meet here first; roots of p and of q)."""
    many_p, many_q = np.zeros(len(p), np.int64), np.zeros(len(q), np.int64)
    hits = []
    for a in range(0, len(p), 512):
        hit = (x[a : a + 512] @ y.T >= cosine) & (p[a : a + 512, None] != q[None, :])
        hits.append(np.packbits(hit, axis=1))
        if before[0].shape[1]:
            hit &= before[0][a : a + 512] @ before[1].T < 0.5
        many_p[a : a + 512] += hit @ sizes[1]
        many_q += sizes[0][a : a + 512] @ hit
    # the smallest node that links reach inside the block
    root_p, root_q = p.copy(), q.copy()
    high = np.iinfo(np.int64).max
    while True:
        new_p, new_q = root_p.copy(), root_q.copy()
        for k, packed in enumerate(hits):
            hit = np.unpackbits(packed, axis=1, count=len(q)).astype(bool)
            rows = slice(512 * k, 512 * k + len(hit))
            new_p[rows] = np.minimum(new_p[rows], np.where(hit, new_q[None, :], high).min(1, initial=high))
            new_q = np.minimum(new_q, np.where(hit, new_p[rows, None], high).min(0, initial=high))
        if (new_p == root_p).all() and (new_q == root_q).all():
            return many_p, many_q, root_p, root_q
        root_p, root_q = new_p, new_q


def _blocks_compared(cosine: float):
    """node, root (a node it is connected with) and n (copies linked to it by pairs that meet here first), for sorted groups _KEYS."""

    def flush(held: list):
        import pyarrow as pa

        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        leaf, dim, i, j = (rows.column(c)[0].as_py() for c in ("leaf", "dim", "i", "j"))
        x = _matrix(rows.column("v"), dim)
        node, size, side = (rows.column(c).to_numpy() for c in ("node", "c", "mine"))
        lists = rows.column("leaves")
        ids = lists.flatten().to_numpy()
        before = _met_before(leaf, np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy())), ids, len(node))
        left, right = (np.arange(len(node)),) * 2 if i == j else (np.flatnonzero(side == i), np.flatnonzero(side == j))
        n_left, n_right, root_left, root_right = compared(x[left], x[right], node[left], node[right], (before[left], before[right]), (size[left], size[right]), cosine)
        n, root = np.zeros(len(node), np.int64), node.copy()
        n[left], root[left] = n_left, root_left
        if i != j:
            n[right], root[right] = n_right, root_right
        on = (n > 0) | (root != node)
        yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(root[on]), pa.array(n[on])], names=["node", "root", "n"])

    def run(batches):
        import pyarrow as pa

        held: list = []
        key = None
        for batch in batches:
            keys = [batch.column(c) for c in _KEYS]
            same = np.ones(max(batch.num_rows - 1, 0), bool)
            for c in keys:
                v = c.dictionary_encode().indices.to_numpy()
                same &= v[1:] == v[:-1]
            edge = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if a == b:
                    continue
                own = tuple(c[a].as_py() for c in keys)
                if held and own != key:
                    yield from flush(held)
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush(held)

    return run


def forest(vectors: DataFrame, cosine: float) -> DataFrame:
    """(leaf, label, node, dim) for every leaf of every tree that a vector goes to."""
    total = vectors.count()
    near = vectors.where(F.pmod(F.xxhash64(F.lit("forest"), "node"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30)))
    kept: dict[int, list] = {}
    for r in near.select("node", "dim", "v").orderBy("node").limit(2 * SAMPLE).collect():
        kept.setdefault(r["dim"], []).append(r["v"])
    depth = max(0, int(np.ceil(np.log2(max(total, 1) / LEAF))))
    trees = {dim: [Tree(unit(rows), depth, SEED + t, _spread(cosine, dim)) for t in range(TREES)] for dim, rows in kept.items()}
    rows = saved(vectors.select("label", "node", "dim", "v").mapInArrow(_placed(trees), _MEMBER), "leaves")
    on = ["leaf", "label", "dim"]
    by_node = vectors.select("node", "v")
    stuck = None  # leaves that a round found indivisible
    while True:
        sizes = rows.groupBy(*on).count().where(F.col("count") > LARGE).select(*on)
        large = saved(sizes if stuck is None else sizes.join(stuck, on, "left_anti"), "large")
        if large.isEmpty():
            break
        cut = saved(rows.join(large, on, "left_semi").join(by_node, "node").select(*[x.split()[0] for x in _MEMBER.split(", ")], "v").mapInArrow(_projected, _MEMBER + ", p double"), "projected")
        middle = saved(cut.groupBy(*on).agg(F.percentile_approx("p", 0.5, 1000).alias("middle"), F.stddev("p").alias("wide")), "middles")
        # a group that lies inside the spill can't be divided
        spill = F.sqrt(F.lit(max(2 - 2 * cosine, 1e-6)) / F.col("dim")) * 0.5
        divided = middle.where(F.col("wide") > 2 * spill)
        firm = middle.where(~(F.col("wide") > 2 * spill)).select(*on)
        stuck = saved(firm if stuck is None else firm.unionAll(stuck), "indivisible")
        side = lambda k: F.xxhash64("leaf", F.lit(k))
        none = F.array().cast("array<long>")
        where = F.concat(F.when(F.col("p") < F.col("middle") + spill, F.array(side(0))).otherwise(none), F.when(F.col("p") >= F.col("middle") - spill, F.array(side(1))).otherwise(none))
        parts = cut.join(divided, on).withColumn("leaf", F.explode(where)).select("leaf", "label", "node", "dim")
        new = saved(rows.join(divided.select(*on), on, "left_anti").select("leaf", "label", "node", "dim").unionAll(parts), "leaves")
        discard(rows, cut)
        rows = new
    return rows


def _blocks(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors in groups (leaf, label, dim) and pairs of blocks: one block up to 2 * BLOCK rows, else every pair of as many as it takes."""
    on = ["leaf", "label", "dim"]
    big = saved(members.groupBy(*on).count().where(F.col("count") > 2 * BLOCK).select(*on, F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")), "big")
    lists = members.join(big, on, "left").groupBy("node").agg(F.collect_list(F.struct("leaf", F.coalesce("parts", F.lit(1)).alias("parts"))).alias("places"))
    each = vectors.join(lists, "node").select("node", "label", "dim", "c", "v", F.transform("places", lambda p: p["leaf"]).alias("leaves"), F.explode("places").alias("place"))
    each = each.withColumn("mine", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("place.parts")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("place.parts") - 1)))
    return each.select(F.col("place.leaf").alias("leaf"), "label", "dim", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "c", "v", "leaves")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    v = F.col("embedding")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"), F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)).alias("sound"))
    own = [F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit("second"), "label", "v").alias("k2")]
    members = saved(rows.where("sound").select("vec_id", *own).distinct(), "members")
    classes = saved(rows.where("sound").select("vec_id", "v", "label", *own).groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("c"), F.first("v").alias("v"), F.first("label").alias("label")), "classes")
    vectors = classes.select("label", "node", F.size("v").alias("dim"), "c", "v")
    grouped = _blocks(forest(vectors, cosine), vectors).repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    found = saved(grouped.mapInArrow(_blocks_compared(cosine), _FOUND), "found")
    degree = found.groupBy("node").agg(F.sum("n").alias("more"))
    named = components(saved(found.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct(), "forest-edges"))
    per_class = classes.join(degree.withColumnRenamed("node", "d"), F.col("node") == F.col("d"), "left").join(named.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    per_class = saved(per_class.select("k1", "k2", (F.coalesce("more", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "per-class")
    told = members.join(per_class, ["k1", "k2"]).select("vec_id", "n_links", "component")
    out = rows.select("vec_id", "sound").join(told.groupBy(F.col("vec_id").alias("id")).agg(F.max("n_links").alias("n_links"), F.min("component").alias("component")), F.col("vec_id") == F.col("id"), "left")
    n = F.when(F.col("sound"), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    comp = F.when(F.col("sound"), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", n.alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))
