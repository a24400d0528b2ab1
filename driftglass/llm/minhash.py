"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has t coordinates. In round i every shingle is thrown into a bin by the i-th hash and offers i plus
a fraction; a bin keeps the smallest offer, so bins that a round fills are settled. From round t on, round
t + j puts all shingles into bin j, which fills whatever is left: every coordinate is defined after at most 2t
rounds and agrees between two sets with a probability of their Jaccard similarity, concentrated as if
drawn without replacement. Bands of coordinates are bucket keys; documents in a bucket are compared on their full
sets. Documents with equal sets are one class from the start.

Within a bucket no list of all pairs is made. First every member is compared with one leader, the member that most
bucket places lead to (the text that others are copies of, if there is one); what that links is settled. Then members
of other components than the leader's are compared with all members: blocks of at most `BLOCK` documents on either
side meet in a task with their sets, which are counted against each other as matrices, and a task returns the links that join
components, never more than it has documents. Pairs of one component are all that is left out: they cannot
change anything. Buckets that hold the same documents are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, gathered, hash_shingles, hash_words, mix, pieces, stage, unstage, whole_row

COORDINATES = 125

#: Chance of missing a pair that is just similar enough, at most.
MISS = 1e-6


def banding(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): the longest bands by which a pair at the limit is missed with a chance of `miss` at most."""
    for rows in range(16, 0, -1):
        if (1 - similarity**rows) ** (coordinates // rows) <= miss:
            return rows, coordinates // rows
    return 1, coordinates


def shingle_sets(raws: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and the text that each belongs to, ordered by text and hash."""
    hashes, owners = hash_shingles(*hash_words(raws), words)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], owners[new]


def sketches(hashes: np.ndarray, owners: np.ndarray, n: int, t: int, seed: int = 1) -> np.ndarray:
    """(n x t) sketches of the sets; a coordinate is the round in its top byte and the offer below. Rows of empty sets are all ones."""
    empty = np.iinfo(np.uint64).max
    out = np.full(n * t, empty, dtype=np.uint64)
    seeds = mix(np.arange(2 * t, dtype=np.uint64) + np.uint64(seed << 32))
    base = owners.astype(np.int64) * t
    for i in range(2 * t):
        if not len(hashes):
            break
        drawn = mix(hashes ^ seeds[i])
        at = base + ((drawn >> np.uint64(32)) % np.uint64(t)).astype(np.int64) if i < t else base + (i - t)
        offer = (np.uint64(i) << np.uint64(56)) | (mix(drawn) >> np.uint64(8))
        unfilled = (out[at] == empty) | (out[at] >> np.uint64(56) == i)
        np.minimum.at(out, at[unfilled], offer[unfilled])
        left = (out.reshape(n, t) == empty).any(axis=1)
        live = left[base // t]
        if not live.all():
            hashes, base = hashes[live], base[live]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(n x bands) 64-bit keys of runs of coordinates, each with its band mixed in."""
    keys = np.zeros((len(sketch), bands), dtype=np.uint64)
    for b in range(bands):
        k = np.full(len(sketch), b + 1, dtype=np.uint64)
        for r in range(rows):
            k = mix(k * np.uint64(0x9E3779B97F4A7C15) ^ sketch[:, b * rows + r])
        keys[:, b] = k
    return keys


def _sketch_batches(words: int, rows: int, bands: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for k in range(0, batch.num_rows, 2048):
                for first, raws in pieces(texts.slice(k, 2048).to_pylist()):
                    n = len(raws)
                    hashes, owners = shingle_sets(raws, words)
                    count = np.bincount(owners, minlength=n)
                    begin = np.r_[0, np.cumsum(count)]
                    full = np.flatnonzero(count)
                    h1, h2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
                    if len(full):
                        h1[full] = mix(np.add.reduceat(mix(hashes), begin[full]))
                        h2[full] = mix(np.bitwise_xor.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), begin[full]))
                    keys = band_keys(sketches(hashes, owners, n, rows * bands), rows, bands).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(k + first, n), pa.array(count, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                         pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(keys.ravel())),
                         *[c.slice(k + first, n) for c in batch.columns[2:]]],
                        names=["doc_id", "n", "h1", "h2", "keys", *batch.schema.names[2:]])

    return run


def _set_batches(words: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for k in range(0, batch.num_rows, 2048):
                for first, raws in pieces(texts.slice(k, 2048).to_pylist()):
                    hashes, owners = shingle_sets(raws, words)
                    begin = np.searchsorted(owners, np.arange(len(raws) + 1))
                    h1 = np.zeros(len(raws), dtype=np.uint64)
                    full = np.flatnonzero(np.diff(begin))
                    if len(full):
                        h1[full] = mix(np.add.reduceat(mix(hashes), begin[full]))
                    sets = [hashes[s:e].tobytes() for s, e in zip(begin, begin[1:])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k + first, len(raws)), pa.array(h1.view(np.int64)), pa.array(sets, pa.binary())], names=["id", "h1", "shingles"])

    return run


def _sets(column) -> list[np.ndarray]:
    """The sets of a binary column, as views of it."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return [np.frombuffer(value.as_buffer(), dtype=np.uint64) for part in parts for value in part]


def _verify_batches(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(_sets(batch.column(2)), _sets(batch.column(3)))):
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared = int((y[at] == x).sum()) if len(y) else 0
                if shared and 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(k)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    return run


#: Documents, and bytes of their sets, on either side of a comparison of blocks.
BLOCK, BLOCK_BYTES = 512, 16 << 20

#: Rows, and bytes of their sets, that one Python call gets about.
CALL, CALL_BYTES = 2000, 16 << 20

#: Shingles of the sets in a file of a small table, about (4 MB).
FILE_SHINGLES = 1 << 19


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """(left x right) sizes of the intersections of sets of hashes, `columns` distinct hashes at a time."""
    owners = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left] + [len(x) for x in right])
    values = np.concatenate([*left, *right])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    new = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    owners, column = owners[often], column[often]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
    for first in range(0, int(column[-1]) + 1, columns):
        s, e = np.searchsorted(column, [first, first + columns])
        x = np.zeros((len(left) + len(right), min(columns, int(column[-1]) + 1 - first)), dtype=np.float32)
        x[owners[s:e], column[s:e] - first] = 1
        out += x[: len(left)] @ x[len(left):].T
    return out


def _join_blocks(percent: int, id_type: str):
    """Per (key, i, j): compare the rows apart (side 0) with all members (side 1); links that join components."""
    def run(table: pa.Table) -> pa.Table:
        found: list[tuple] = []
        keys = table.column("key").to_numpy()
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        order = np.lexsort((table.column("side").to_numpy(), j, i, keys))
        cut = np.flatnonzero(np.r_[True, (keys[order][1:] != keys[order][:-1]) | (i[order][1:] != i[order][:-1]) | (j[order][1:] != j[order][:-1])])
        ids, names = table.column("id").to_pylist(), {}
        component = np.array([names.setdefault(c, len(names)) for c in table.column("component").to_pylist()], dtype=np.int64)
        side, sets = table.column("side").to_numpy(), _sets(table.column("shingles"))
        for s, e in zip(cut, np.r_[cut[1:], len(order)]):
            rows = order[s:e]
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            if not len(left) or not len(right):
                continue
            x, y = ([sets[int(k)] for k in part] for part in (left, right))
            nx, ny = (np.array([len(v) for v in part], dtype=np.float64) for part in (x, y))
            both = shared_counts(x, y).astype(np.float64)
            p, q = np.nonzero((100 * both >= percent * (nx[:, None] + ny[None, :] - both)) & (both > 0))
            del x, y, both
            # One link for each pair of components is enough.
            u, v = component[left[p]], component[right[q]]
            _, first = np.unique(np.minimum(u, v) * len(names) + np.maximum(u, v), return_index=True)
            root: dict = {}

            def find(c):
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for k in first.tolist():
                u, v = find(int(component[left[p[k]]])), find(int(component[right[q[k]]]))
                if u != v:
                    root[max(u, v)] = min(u, v)
                    found.append((ids[left[p[k]]], ids[right[q[k]]]))
        kind = table.schema.field("id").type
        return pa.table({"a": pa.array([f[0] for f in found], kind), "b": pa.array([f[1] for f in found], kind)})

    return run


def _similar(pairs: DataFrame, sets: DataFrame, percent: int, id_type: str) -> DataFrame:
    """The pairs (a, ah, b, bh) whose full sets are similar enough, as (a, b)."""
    one = sets.select(F.col("id").alias("a"), F.col("h1").alias("ah"), F.col("shingles").alias("left"))
    two = sets.select(F.col("id").alias("b"), F.col("h1").alias("bh"), F.col("shingles").alias("right"))
    full = pairs.join(two, ["b", "bh"]).join(one, ["a", "ah"]).select("a", "b", "left", "right")
    return full.mapInArrow(_verify_batches(percent), f"a {id_type}, b {id_type}")


def near_documents(documents: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of documents.

    Shingles are runs of `words` words (A-Z lower-cased); a text of fewer words is one shingle, one without words or
    a null text has none and links with nothing. Sets link if 100 * shared >= percent * all. Rows of one id are one
    document: they are in one component, those without words too. Rows without an id get the component of equal sets, if
    any has an id, and are not kept then. The component is the smallest id reached; kept marks rows that have it as id.
    Repeated rows come as often as they are there; an empty table gives no rows; other columns are not read.
    """
    return _near_documents(documents, words, percent, block)


def _near_documents(documents: DataFrame, words: int, percent: int, block: int, **carried: Column) -> DataFrame:
    """near_documents() with columns of 64-bit integers that are carried along."""
    rows, bands = banding(percent / 100)
    id_type = dict(documents.dtypes)["doc_id"]
    again = lambda c: F.bitwise_not(F.bitwise_not(c)).alias(c)  # noqa: E731  deals a counted key anew, so that the join can split it
    told = stage(documents.select("doc_id", "text", *[c.alias(name) for name, c in carried.items()]).mapInArrow(
        _sketch_batches(words, rows, bands), ", ".join([f"doc_id {id_type}, n int, h1 long, h2 long, keys array<long>", *[f"{name} long" for name in carried]])), "sketches")
    n_rows, n_shingles = told.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    filled = told.filter("n > 0 and doc_id is not null")
    classes = stage(gathered(filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("id")), n_rows), "classes")
    # Ids that come with several sets, each set once, and the links that tie the classes of these.
    several = told.filter("doc_id is not null").groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("h1", "h2")])
    several = several.filter("min_h1 <> max_h1 or min_h2 <> max_h2").select(again("doc_id"))
    several = stage(gathered(filled.select("doc_id", "h1", "h2").join(several, "doc_id").distinct(), n_rows), "several")
    tied = several.join(classes, ["h1", "h2"]).filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    members = (filled.join(classes.withColumnsRenamed({"h1": "c1", "h2": "c2"}), (F.col("doc_id") == F.col("id")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
               .dropDuplicates(["id", "h1", "h2"]).select("id", "h1", "n", F.explode("keys").alias("key")))
    members = stage(gathered(members, n_rows * bands), "members")
    held = members.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id", "h1")).alias("s1"), F.bit_xor(F.xxhash64("h1", "id")).alias("s2")).filter("c > 1")
    held = held.groupBy("c", "s1", "s2").agg(F.min("key").alias("key")).select("key", "c")
    crowded = stage(gathered(members.join(held, "key"), n_rows * bands), "buckets")
    places = crowded.count()
    unstage(members)
    wanted = crowded.select("id").distinct().hint("shuffle_hash")  # the same plan at every size
    sets = (documents.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
            .mapInArrow(_set_batches(words), f"id {id_type}, h1 long, shingles binary")
            .dropDuplicates(["id", "h1"]))
    sets = stage(gathered(sets, n_shingles, FILE_SHINGLES), "sets")

    central = crowded.groupBy("id", "h1").agg(F.sum("c").alias("places"))
    ranked = crowded.join(central, ["id", "h1"])
    leaders = ranked.groupBy("key").agg(F.max(F.struct("places", "id", "h1", "n")).alias("s")).select(again("key"), F.col("s.id").alias("a"), F.col("s.h1").alias("ah"), F.col("s.n").alias("m"))
    leaders = stage(gathered(leaders, places), "leaders")
    close = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    pairs = crowded.join(leaders, "key").filter((F.col("id") != F.col("a")) & close).select("a", "ah", F.col("id").alias("b"), F.col("h1").alias("bh")).distinct()
    links = stage(gathered(_similar(pairs, sets, percent, id_type).union(tied), places + n_rows), "pairs")
    star = components(links, "a", "b")

    named = star.withColumnRenamed("id", "f")
    main = leaders.join(named, F.col("a") == F.col("f"), "left").select(again("key"), F.coalesce("component", "a").alias("main"))
    placed = crowded.join(named, F.col("id") == F.col("f"), "left").select("key", "id", "h1", "n", F.coalesce("component", "id").alias("component"))
    placed = stage(gathered(placed.join(main, "key"), places), "placed")
    several_blocks = lambda rows, n: F.greatest(F.ceil(rows / block), F.ceil(n * 8 / BLOCK_BYTES), F.lit(1)).cast("int")
    far = F.col("component") != F.col("main")
    size = lambda c: F.sum(c.cast("long"))
    apart = (placed.groupBy("key").agg(size(far).alias("apart"), size(far.cast("int") * F.col("n")).alias("m"), F.count("*").alias("c"), size(F.col("n")).alias("all"))
             .filter("apart > 0").select(again("key"), several_blocks(F.col("apart"), F.col("m")).alias("bi"), several_blocks(F.col("c"), F.col("all")).alias("bj")))
    live = placed.join(apart, "key")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = (live.filter(far).select("key", "id", "h1", "n", "component", F.lit(0).alias("side"), own("bi").alias("i"), every("bj").alias("j"))
             .union(live.select("key", "id", "h1", "n", "component", F.lit(1).alias("side"), every("bi").alias("i"), own("bj").alias("j"))))
    sides = stage(sides, "sides")
    rows_met, shingles_met = sides.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    calls = max(1, rows_met // CALL, 8 * shingles_met // CALL_BYTES)
    met = sides.drop("n").join(sets.withColumnRenamed("id", "sid").withColumnRenamed("h1", "sh"), (F.col("id") == F.col("sid")) & (F.col("h1") == F.col("sh")))
    met = met.select("key", "i", "j", "side", "id", "component", "shingles", F.pmod(F.xxhash64("key", "i", "j"), F.lit(calls)).alias("call"))
    more = stage(met.groupBy("call").applyInArrow(_join_blocks(percent, id_type), f"a {id_type}, b {id_type}"), "joins")
    found = components(links.union(more), "a", "b") if not more.isEmpty() else star
    unstage(crowded, sets, leaders, links, placed, sides, more, *([star] if found is not star else []))

    ends = classes.join(found.withColumnRenamed("id", "f"), F.col("id") == F.col("f"), "left").select("h1", "h2", F.coalesce("component", "id").alias("component"))
    owned = several.join(ends, ["h1", "h2"]).groupBy("doc_id").agg(F.min("component").alias("component")).select(again("doc_id"), "component")
    full = told.filter("n > 0").join(ends, ["h1", "h2"], "left").select("doc_id", "n", "component", *carried)
    bare = told.filter("n = 0").join(owned, "doc_id", "left").select("doc_id", "n", "component", *carried)
    component = F.coalesce("component", "doc_id")
    return full.union(bare).select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), *carried)


def deduplicate(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without the rows that near_documents() marks as not kept; all columns stay, whatever their names.

    A row is known by its id, which may be null, and two hashes of its text, so repeated rows stay or go together. Texts
    without words, null ones too, link with nothing and stay; an empty table stays empty.
    """
    gone = _near_documents(documents, words, percent, BLOCK, t1=F.xxhash64("text"), t2=F.xxhash64(F.lit(1), "text")).filter("not kept")
    gone = gone.select(F.col("doc_id").alias("gone"), F.col("t1").alias("g1"), F.col("t2").alias("g2")).distinct().hint("shuffle_hash")
    rows = documents.select(whole_row(documents).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    same = F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2"))
    return rows.join(gone, same, "left_anti").select("row.*")
