"""Near-duplicate vectors by a random-projection tree forest with spill.

Many trees split the unit vectors of a label by random directions at medians; a vector near a split goes to
both sides. Vectors that meet in a leaf are compared in double precision. A pair is counted in the
first leaf that both share (each vector knows its leaves), so no list of pairs is made, moved or deduplicated:
a leaf gives one row per linked vector, with its number of links and the root of its group there.
Equal vectors are one class from the start.

The splits are fitted on a bounded sample; every vector is routed. Where the sample has run out but the rows it
stands for would still fill more than a leaf, splitting goes on through the middle of the node's sample, by directions that all
nodes of one depth share, so the forest that is sent to the tasks stays as small as the sample and leaves do
not grow with the data. How wide the spill is and how many trees are grown follows from a measurement: sample vectors and
partners made just similar enough are routed together, and the cheapest width of spill whose trees miss such a pair
with a chance of `miss` at most is taken. Leaves are counted after routing; one that stays large because its vectors
cannot be split is compared in blocks, each pair of blocks a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stage, unstage

#: Sample rows below which a node is split through its middle instead of at a median.
LEAST = 16

#: Levels that may follow below a node whose sample has run out: a leaf's number has so many bits for them.
DEEPER = 24

#: Widths of the spill to choose from, in standard deviations of what a direction shows of a pair at the limit.
SPILLS = (1.0, 0.5, 0.25)

#: Trees that one forest has at most.
MOST_TREES = 64

#: Made pairs that a width of spill is measured on.
PROBES = 4096


class Forest:
    """Trees of one (label, width). A node is (direction, at, left, right) or a leaf: its number, and how many levels follow about its middle."""

    def __init__(self, sample: np.ndarray, scale: float, least: float, leaf_rows: int, trees: int | None, spill: float | None, miss: float, seed: int):
        self.scale, self.leaf_rows, self.seed = scale, leaf_rows, seed
        self.trees, self.leaves, self.margin, self.levels = [], 0, 0.0, []
        if len(sample) * scale <= leaf_rows:  # one leaf holds them all: more trees would find nothing more
            self._add(sample)
            return
        step = np.sqrt(2 - 2 * least) / np.sqrt(sample.shape[1])
        tried = []
        for width in SPILLS if spill is None else (spill,):
            self.margin = width * step
            self._clear()
            self._add(sample)
            entries = len(self.route(sample)[0]) / len(sample)
            count = trees or min(MOST_TREES, max(1, int(np.ceil(np.log(miss) / np.log(self.missed(sample, least))))))
            tried.append((entries * count, width, count))
        _, width, count = min(tried)
        self.margin = width * step
        self._clear()
        for _ in range(count):
            self._add(sample)

    def _clear(self) -> None:
        self.trees, self.leaves, self.levels = [], 0, []

    def _add(self, sample: np.ndarray) -> None:
        random = np.random.default_rng([self.seed, len(self.trees)])
        shared = random.standard_normal((DEEPER, sample.shape[1]))
        self.levels.append(shared / np.linalg.norm(shared, axis=1, keepdims=True))
        self.trees.append(self._grow(sample, np.arange(len(sample)), random, len(self.trees)))

    def _grow(self, x: np.ndarray, rows: np.ndarray, random, tree: int) -> dict:
        said, more, middle = len(rows) * self.scale, 0, None
        if said > self.leaf_rows and len(rows) >= LEAST:
            for _ in range(4):
                direction = random.standard_normal(x.shape[1])
                direction /= np.linalg.norm(direction)
                at = x[rows] @ direction
                cut = float(np.median(at))
                left, right = rows[at <= cut + self.margin], rows[at >= cut - self.margin]
                if max(len(left), len(right)) <= 0.9 * len(rows):
                    return {"direction": direction, "at": cut, "left": self._grow(x, left, random, tree), "right": self._grow(x, right, random, tree)}
        elif said > self.leaf_rows:
            middle = x[rows].mean(axis=0)
            more = min(DEEPER, int(np.ceil(np.log2(said / self.leaf_rows))))
        self.leaves += 1
        return {"leaf": self.leaves, "tree": tree, "more": more, "middle": middle}

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that each row of x falls into. Leaves of later trees have larger numbers."""
        rows, leaves = [], []
        stack = [(t, np.arange(len(x))) for t in self.trees]
        while stack:
            node, own = stack.pop()
            if not len(own):
                continue
            if "leaf" not in node:
                at = x[own] @ node["direction"]
                stack.append((node["left"], own[at <= node["at"] + self.margin]))
                stack.append((node["right"], own[at >= node["at"] - self.margin]))
                continue
            code = np.full(len(own), node["leaf"] << DEEPER, dtype=np.int64)
            for level in range(node["more"]):
                direction = self.levels[node["tree"]][level]
                at = (x[own] - node["middle"]) @ direction
                low, high = at <= self.margin, at >= -self.margin
                own, code = np.r_[own[low], own[high]], np.r_[code[low], code[high] | 1 << level]
            rows.append(own)
            leaves.append(code)
        return np.concatenate(rows), np.concatenate(leaves)

    def missed(self, sample: np.ndarray, least: float) -> float:
        """The share of pairs with a cosine of `least` that no tree brings together, counted on made pairs (half a pair more is taken as missed)."""
        random = np.random.default_rng([self.seed, 1 << 20])
        x = sample[random.integers(0, len(sample), PROBES)]
        away = random.standard_normal(x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        length = np.linalg.norm(away, axis=1, keepdims=True)
        y = least * x + np.sqrt(max(0.0, 1 - least * least)) * away / np.where(length > 0, length, 1)
        places = [row + leaf * PROBES for row, leaf in map(self.route, (x, y))]
        met = len(np.unique(np.intersect1d(*places) % PROBES))
        return (PROBES - met + 0.5) / (PROBES + 1)


def _lists(column) -> np.ndarray:
    """A list column whose rows have one length, as a matrix of doubles."""
    column = _whole(column)
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def _whole(column):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def links(a: np.ndarray, b: np.ndarray, least: float, block: int = 256):
    """Blocks of (i, j) with cosine of a[i] and b[j] at least `least`; a and b are unit vectors in doubles.

    Products of `block` rows with all of b are taken at a time; those within rounding of the limit are summed again, alike wherever
    the pair meets.
    """
    for s in range(0, len(a), block):
        found = a[s:s + block] @ b.T
        linked = found >= least
        i, j = np.nonzero(np.abs(found - least) < 1e-9)
        if len(i):
            linked[i, j] = np.einsum("ij,ij->i", a[s + i], b[j]) >= least
        i, j = np.nonzero(linked)
        if len(i):
            yield s + i, j


def smaller_leaves(column, leaf: int) -> np.ndarray:
    """(rows x words) bit sets of the leaves below `leaf` in a column of lists; only leaves of several rows have a bit."""
    lists = _whole(column)
    owners = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    leaves = lists.flatten().to_numpy(zero_copy_only=False)
    owners, leaves = owners[leaves < leaf], leaves[leaves < leaf]
    _, code, times = np.unique(leaves, return_inverse=True, return_counts=True)
    often = times > 1
    bit = (np.cumsum(often) - 1)[code[often[code]]]
    owners = owners[often[code]]
    out = np.zeros((len(lists), max(1, -(-int(often.sum()) // 64))), dtype=np.uint64)
    np.bitwise_or.at(out, (owners, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return out


def join_roots(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Merge the groups of p[k] and q[k] for all k; root[i] is the smallest row of i's group before and after."""
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def compare(table: pa.Table, least: float, pairs: int = 32768) -> pa.Table:
    """Links within a leaf, or between two of its blocks (columns i <= j of the group, own block in `block`).

    For each linked row: its class, the links counted here (weighted by class sizes) and its group's root. Pairs are looked at
    in slices of `pairs`.
    """
    table = table.take(pa.array(np.argsort(table.column("rep").to_numpy(), kind="stable")))
    n = table.num_rows
    x, size = unit(_lists(table.column("v"))), table.column("n").to_numpy()
    leaf, block = int(table.column("leaf")[0].as_py()), table.column("block").to_numpy()
    i, j = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    count, root, linked = np.zeros(n, dtype=np.int64), np.arange(n), np.zeros(n, dtype=bool)
    before = None
    for p, q in links(x[left], x[right], least):
        p, q = left[p], right[q]
        if i == j:
            p, q = p[p < q], q[p < q]
        if not len(p):
            continue
        linked[p] = linked[q] = True
        join_roots(root, p, q)
        before = smaller_leaves(table.column("leaves"), leaf) if before is None else before
        for s in range(0, len(p), pairs):
            u, v = p[s:s + pairs], q[s:s + pairs]
            first = ~(before[u] & before[v]).any(axis=1)
            count += np.bincount(u[first], size[v[first]], n).astype(np.int64) + np.bincount(v[first], size[u[first]], n).astype(np.int64)
    rows = np.flatnonzero(linked)
    told = table.take(pa.array(rows))
    return pa.table({"h1": told.column("h1"), "h2": told.column("h2"), "rep": told.column("rep"), "links": pa.array(count[rows], pa.int64()), "root": table.column("rep").take(pa.array(root[rows]))})


def near_vectors(vectors: DataFrame, least: float = 0.93, trees: int | None = None, leaf_rows: int = 1024, spill: float | None = None, miss: float = 1e-6,
                 sample_rows: int = 20_000, sample_bytes: int = 32 << 20, seed: int = 7, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors.

    Vectors of equal, non-null label and equal width link if their cosine is at least `least`. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows without a label or an id, link with nothing:
    no links, and a component of their own. Equal rows link with each other (a repeated row counts its
    copies); rows that share an id but not the vector count their own links and share a component. An empty table gives no rows;
    other columns are not read.
    `spill` is half the width of the zone that goes to both sides, in standard deviations of what a random
    direction shows of a pair at the limit; it and `trees` are measured (see above) unless given. The sample has about `sample_rows`
    vectors, fewer if those would take over `sample_bytes`.
    """
    e = F.col(embedding)
    fine = (e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(e, lambda x: x != 0) & F.col(label).isNotNull() & F.col(vec_id).isNotNull())
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), e.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    keyed = rows.select("vec_id", "label", "v", "fine", F.when(F.col("fine"), F.xxhash64("label", "v")).alias("h1"), F.when(F.col("fine"), F.xxhash64(F.lit(seed), "v", "label")).alias("h2"))
    spark = vectors.sparkSession
    classes = stage(keyed.filter("fine").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
        .withColumn("width", F.size("v")), "classes")
    total, widest = classes.agg(F.count("*"), F.max("width")).head()
    wanted = min(sample_rows, sample_bytes // (8 * (widest or 1)))
    rate = min(1.0, wanted / max(total, 1))
    picked = classes.filter(F.pmod("h2", F.lit(1 << 30)) < int(rate * (1 << 30))).limit(2 * wanted)
    sample = picked.select("label", "width", "v").toArrow()
    groups: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(sample.column("label").to_pylist(), sample.column("width").to_pylist())):
        groups.setdefault(key, []).append(k)
    forests = {}
    for key in sorted(groups, key=str):
        x = unit(_lists(sample.column("v").take(pa.array(groups[key]))))
        forests[key] = Forest(x, 1 / rate, least, leaf_rows, trees, spill, miss, seed)
    shared = spark.sparkContext.broadcast(forests)

    def leaves_of(batch):
        """For each (label, width) of a batch: the rows, and (row, leaf) in order."""
        keys: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("width").to_pylist())):
            keys.setdefault(key, []).append(k)
        for key, own in keys.items():
            part = batch.take(pa.array(own))
            forest = shared.value.get(key)
            if forest is None or not forest.trees:
                row, leaf = np.arange(len(own)), np.zeros(len(own), np.int64)
            else:
                row, leaf = forest.route(unit(_lists(part.column("v"))))
            order = np.lexsort((leaf, row))
            yield part, row[order], leaf[order]

    def sizes(batches):
        for batch in batches:
            for part, _, leaf in leaves_of(batch):
                leaf, n = np.unique(leaf, return_counts=True)
                key = part.slice(0, 1).take(pa.array(np.zeros(len(leaf), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([key.column("label"), key.column("width"), pa.array(leaf), pa.array(n)], names=["label", "width", "leaf", "n"])

    def route(batches):
        for batch in batches:
            for part, row, leaf in leaves_of(batch):
                begin = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(leaf, pa.int64()))
                for s in range(0, len(row), 8192):
                    pick = pa.array(row[s:s + 8192])
                    told = part.take(pick)
                    yield pa.RecordBatch.from_arrays([told.column(x) for x in names] + [pa.array(leaf[s:s + 8192]), lists.take(pick)], names=[*names, "leaf", "leaves"])

    kind = dict(classes.dtypes)
    names = ["label", "width", "h1", "h2", "rep", "n", "v"]
    known = classes.select(names)
    crowded = (known.select("label", "width", "v").mapInArrow(sizes, f"label {kind['label']}, width int, leaf long, n long").groupBy("label", "width", "leaf").agg(F.sum("n").alias("n"))
               .filter(F.col("n") > 2 * leaf_rows).select("label", "width", "leaf", F.ceil(F.col("n") / leaf_rows).cast("int").alias("blocks")))
    crowded = stage(crowded, "crowded")
    routed = known.mapInArrow(route, f"label {kind['label']}, width int, h1 long, h2 long, rep {kind['rep']}, n long, v {kind['v']}, leaf long, leaves array<long>")
    routed = routed.join(crowded, ["label", "width", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # A row in block b goes to the pairs (min(b, c), max(b, c)) for every block c.
    routed = routed.withColumn("block", F.pmod(F.shiftright("h1", 20), F.col("blocks")).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    routed = routed.withColumns({"i": F.least("block", "c"), "j": F.greatest("block", "c")}).drop("blocks", "c")
    found = stage(routed.groupBy("label", "width", "leaf", "i", "j").applyInArrow(
        lambda table: compare(table, least), f"h1 long, h2 long, rep {kind['rep']}, links long, root {kind['rep']}"), "links")
    counts = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    # Rows of one id with different vectors are in several classes, which are tied here.
    several = keyed.filter("fine").groupBy("vec_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select(F.col("vec_id").alias("again"))
    tied = keyed.filter("fine").join(several, F.col("vec_id") == F.col("again")).join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", F.col("vec_id").alias("root"))
    own = components(found.select("rep", "root").union(tied), "rep", "root")
    told = classes.select("h1", "h2", "rep", "n").join(counts, ["h1", "h2"], "left").join(own, F.col("rep") == F.col("id"), "left")
    told = told.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    told = stage(told, "classes-linked")
    unstage(classes, crowded, found, own)
    joined = keyed.select("vec_id", "h1", "h2").join(told, ["h1", "h2"], "left")
    component = F.coalesce(F.col("component_id"), F.col("vec_id"))
    return joined.select(F.col("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         component.eqNullSafe(F.col("vec_id")).alias("kept"))
