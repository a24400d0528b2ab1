"""A convolutional text classifier in numpy: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the sum of hashed vectors of the word and of its beginnings, so forms of one stem
share what is learnt. Filters of each width slide over the words; every filter keeps its largest response over
the whole text; a logistic layer and a Platt scale fitted on documents kept out of training make the
score. Counts, training, scale and thresholds use every labelled document, in tasks. Thresholds that decide what is rejected are calibrated for each language on those documents, by
which the score itself never sees a language.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import with_ranks
from .common import gathered, hash_spans, mix, pieces, stage, unstage, whole_row

#: Bytes that make up words: ASCII letters and digits, and everything beyond ASCII.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Lengths in bytes of the beginnings that share an embedding.
PREFIXES = (4, 5, 6, 7, 8)

#: Bytes of a part of a long text, and of short texts that are worked on together.
_SEGMENT, _GROUP = 1 << 18, 1 << 18


def features(raws: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers (different words x features: the word, then its beginnings; A-Z count as a-z) of several texts, which of these each word
    is, and how many words each text has."""
    data = np.frombuffer(b"\n".join(raws).lower(), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _IN_WORD[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
    words, first, which = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    out = np.empty((len(words), 1 + len(PREFIXES)), dtype=np.int32)
    out[:, 0] = words % np.uint64(buckets)
    order = np.argsort(first)
    begin, end = starts[first[order]], ends[first[order]]
    for k, length in enumerate(PREFIXES, 1):
        h = hash_spans(data, begin, np.minimum(end, begin + length))
        out[order, k] = mix(h ^ np.uint64(k)) % np.uint64(buckets)
    return out, which, np.diff(bounds)


def segments(raw: bytes, overlap: int, size: int = _SEGMENT):
    """A text in parts of about `size` bytes, cut between words; each part but the first repeats `overlap` words."""
    at = 0
    while True:
        end = min(len(raw), at + size)
        while end < len(raw) and _IN_WORD[raw[end]]:
            end += 1
        yield raw[at:end]
        if end >= len(raw):
            return
        back, words = end, 0
        while back > at + 1 and words < overlap:
            while back > at + 1 and not _IN_WORD[raw[back - 1]]:
                back -= 1
            while back > at + 1 and _IN_WORD[raw[back - 1]]:
                back -= 1
            words += 1
        at = back if back > at + 1 else end


@dataclass
class Network:
    """The classifier's numbers. Filters of width w have weights (w, dim, filters)."""

    buckets: int
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    output: np.ndarray
    intercept: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)
    threshold: float = 0.5

    def words(self, ids: np.ndarray) -> np.ndarray:
        x = self.embedding[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.embedding[ids[:, k]]
        return x

    def responses(self, x: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
        """Responses of each width's filters from every row of x on, rows beyond its end being zeros. Only `words` are rows of words: others
        are zeros behind a text, from which on no filter responds to the next one."""
        n, found = len(x), []
        gap = np.ones(n, dtype=bool)
        gap[words] = False
        for w in self.filters:
            r = x @ w[0]
            for k in range(1, len(w)):
                if n > k:
                    r[:n - k] += x[k:] @ w[k]
            r[gap] = 0
            found.append(r)
        return found

    def pooled(self, raws: list[bytes]) -> np.ndarray:
        """Largest responses (texts x all filters) over whole texts; a text without words has those of no words, 0."""
        wide = max(len(w) for w in self.filters)
        out = np.full((len(raws), len(self.bias)), -np.inf, dtype=np.float32)
        held, owners, size = [], [], 0

        def run() -> None:
            ids, which, count = features(held, self.buckets)
            starts = np.r_[0, np.cumsum(count + wide)]
            x = np.zeros((starts[-1], self.embedding.shape[1]), dtype=np.float32)
            at = np.arange(len(which)) + wide * np.repeat(np.arange(len(count)), count)
            x[at] = self.words(ids)[which]
            best = np.concatenate([np.maximum.reduceat(r, starts[:-1], axis=0) for r in self.responses(x, at)], axis=1)
            np.maximum.at(out, owners, best)

        for k, raw in enumerate(raws):
            for part in segments(raw, wide - 1):
                held.append(part)
                owners.append(k)
                size += len(part)
                if size > _GROUP:
                    run()
                    held, owners, size = [], [], 0
        if held:
            run()
        return out

    def logits(self, raws: list[bytes]) -> np.ndarray:
        return np.maximum(self.pooled(raws) + self.bias, 0).astype(np.float64) @ self.output + self.intercept

    def scores(self, raws: list[bytes]) -> np.ndarray:
        return _sigmoid(self.scale[0] * self.logits(raws) + self.scale[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def gradients(net: Network, ids: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray):
    """Of the weighted mean log loss of a batch: by filters, bias and output (with their small ridges), the slopes of the logits, and the
    buckets touched with the gradients of their vectors."""
    wide, dim, filters = max(len(w) for w in net.filters), net.embedding.shape[1], net.filters[0].shape[2]
    own = [np.concatenate([i, np.zeros((wide, i.shape[1]), dtype=np.int32)]) for i in ids]
    lengths = np.array([len(i) for i in own])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    flat = np.concatenate(own)
    x = net.words(flat)
    real = np.ones(len(x), dtype=bool)
    for s, l in zip(starts, lengths):
        real[s + l - wide:s + l] = False
    x[~real] = 0
    found = np.concatenate(net.responses(x, np.flatnonzero(real)), axis=1)
    best = np.maximum.reduceat(found, starts, axis=0)
    at = np.empty(best.shape, dtype=np.int64)
    for d, (s, l) in enumerate(zip(starts, lengths)):
        at[d] = s + found[s:s + l].argmax(axis=0)
    pre = best + net.bias
    act = np.maximum(pre, 0)
    slope = (_sigmoid(act.astype(np.float64) @ net.output + net.intercept) - toxic) * weight / len(ids)
    g_out = act.T @ slope + 1e-4 * net.output
    g_pre = (slope[:, None] * net.output[None, :]) * (pre > 0)
    grads, g_x_at, g_x = [], [], []
    for j, w in enumerate(net.filters):
        cols = slice(j * filters, (j + 1) * filters)
        p = at[:, cols]
        g = g_pre[:, cols] * real[p]  # behind a text nothing responds
        gw = np.zeros(w.shape)
        for o in range(len(w)):
            q = np.minimum(p + o, len(x) - 1)
            gw[o] = np.einsum("dfe,df->ef", x[q], g)
            g_x_at.append(q.ravel())
            g_x.append((g[:, :, None] * w[o].T[None, :, :]).reshape(-1, dim))
        grads.append(gw + 1e-5 * w)
    grads += [g_pre.sum(axis=0), g_out]
    q, g = np.concatenate(g_x_at), np.concatenate(g_x)
    g = g[real[q]]
    rows = flat[q[real[q]]]
    touched, back = np.unique(rows.ravel(), return_inverse=True)
    total = np.zeros((len(touched), dim))
    spread = np.repeat(g, rows.shape[1], axis=0)
    for c in range(dim):
        total[:, c] = np.bincount(back.ravel(), weights=spread[:, c], minlength=len(touched))
    return grads, slope, touched, total


def _split(ids: np.ndarray, which: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    return [ids[own] for own in np.split(which, np.cumsum(count)[:-1])]


def bucket_counts(raws: list[bytes], toxic: np.ndarray, buckets: int, limit: int = _SEGMENT) -> np.ndarray:
    """How many clean and toxic texts (2 x buckets) use each bucket; long texts are looked at in parts."""
    seen = np.zeros((2, buckets), dtype=np.int64)
    for at, some in pieces(raws, limit):
        if len(some) == 1:
            used = [np.unique(np.concatenate([np.unique(features([part], buckets)[0]) for part in segments(some[0], 0)]))]
        else:
            used = [np.unique(i) for i in _split(*features(some, buckets))]
        for t, places in zip(toxic[at:], used):
            seen[int(t), places] += 1
    return seen


def start(seen: np.ndarray, texts: np.ndarray, dim: int = 8, widths: tuple[int, ...] = (1, 2, 3), filters: int = 8, least: int | None = None, share: int = 20, seed: int = 11):
    """The network before training, from the counts by bucket and the numbers of clean and toxic texts, and which buckets are used.

    Vectors of buckets that fewer than `least` documents use (unless given, one in `share` of the toxic ones, 2 to 5) stay 0, so rare words
    cannot be learnt by heart.
    The first coordinate starts from the bucket's log odds of being in a toxic document, the others near 0.
    """
    random, buckets = np.random.default_rng(seed), seen.shape[1]
    n = np.maximum(1, texts)
    used = seen.sum(axis=0) >= (min(5, max(2, int(n[1]) // share)) if least is None else least)
    odds = np.log((seen[1] + 0.5) / n[1]) - np.log((seen[0] + 0.5) / n[0])
    e = (random.standard_normal((buckets, dim)) * 0.02).astype(np.float32)
    e[:, 0] = np.clip(odds, -4, 4) / 8
    e[~used] = 0
    ws = [(random.standard_normal((w, dim, filters)) * 0.3 / w).astype(np.float32) for w in widths]
    for w in ws:
        w[:, 0, :] = np.abs(w[:, 0, :])
    k = filters * len(widths)
    return Network(buckets, e, ws, np.zeros(k, dtype=np.float32), (np.abs(random.standard_normal(k)) * 0.5), -1.0), used


def _excerpt(net: Network, raw: bytes) -> bytes:
    """The parts of a long text that hold a filter's largest response: the rest has no gradient. The whole text is looked at."""
    parts = list(segments(raw, max(len(w) for w in net.filters) - 1, 1 << 12))
    best = np.full(len(net.bias), -np.inf, dtype=np.float32)
    at = np.zeros(len(net.bias), dtype=np.int64)
    for s in range(0, len(parts), 64):
        found = net.pooled(parts[s:s + 64])
        better = found.max(axis=0) > best
        at[better], best[better] = s + found.argmax(axis=0)[better], found.max(axis=0)[better]
    return b"\n".join(parts[k] for k in np.unique(at))


def improve(net: Network, used: np.ndarray, texts: np.ndarray, raws: list[bytes], toxic: np.ndarray, epochs: int = 4, least_steps: int = 240, batch: int = 64, rate: float = 0.01,
            seed: int = 11, longest: int = 1 << 18) -> Network:
    """Fit a network by Adam on the balanced log loss, for `epochs` rounds or as many as `least_steps` batches take; it is changed in place.

    texts are the numbers of clean and toxic texts by which the loss is balanced. Of texts over `longest` bytes every round finds the parts
    that matter by looking at all of them.
    """
    random = np.random.default_rng([seed, 1])
    short = [len(r) <= longest for r in raws]
    ids = [part for _, some in pieces([r if fits else b"" for r, fits in zip(raws, short)]) for part in _split(*features(some, net.buckets))]
    weight = np.where(toxic == 1, 0.5 / max(1, texts[1]), 0.5 / max(1, texts[0])) * texts.sum()
    parameters = [*net.filters, net.bias, net.output]
    first = [np.zeros(p.shape) for p in parameters]
    second = [np.zeros(p.shape) for p in parameters]
    c1 = c2 = 0.0
    e2 = np.zeros(net.buckets, dtype=np.float32)
    step = 0
    batches = max(1, len(ids) // batch)
    for _ in range(max(epochs, -(-least_steps // batches))):
        for k in np.flatnonzero(~np.array(short)):
            ids[k] = _split(*features([_excerpt(net, raws[k])], net.buckets))[0]
        for part in np.array_split(random.permutation(len(ids)), batches):
            step += 1
            grads, slope, touched, total = gradients(net, [ids[d] for d in part], toxic[part], weight[part])
            for j, (p, g) in enumerate(zip(parameters, grads)):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                p -= (rate * first[j] / (1 - 0.9**step) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
            c1 = 0.9 * c1 + 0.1 * slope.sum()
            c2 = 0.999 * c2 + 0.001 * slope.sum() ** 2
            net.intercept -= rate * c1 / (1 - 0.9**step) / (np.sqrt(c2 / (1 - 0.999**step)) + 1e-8)
            total[~used[touched]] = 0
            e2[touched] += (total**2).mean(axis=1)
            net.embedding[touched] -= (rate * total / (np.sqrt(e2[touched])[:, None] + 1e-6)).astype(np.float32)
    return net


def platt(logits: DataFrame, rounds: int = 50, penalty: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic fit to (logit, toxic), its targets drawn in by one count for either class. Sums are decimals, so their order does not matter."""
    up, n = (int(v or 0) for v in logits.agg(F.sum("toxic"), F.count("*")).head())
    b = np.array([1.0, 0.0])
    target = F.when(F.col("toxic") == 1, F.lit((up + 1) / (up + 2))).otherwise(F.lit(1 / (n - up + 2)))
    for _ in range(rounds):
        x, p = F.col("logit"), 1 / (1 + F.exp(-(F.lit(float(b[0])) * F.col("logit") + F.lit(float(b[1])))))
        terms = [p * (1 - p) * x * x, p * (1 - p) * x, p * (1 - p), (p - target) * x, p - target]
        xx, x1, one, gx, g1 = (float(v) for v in logits.agg(*[F.sum(t.cast("decimal(28,14)")) for t in terms]).head())
        h = np.array([[xx, x1], [x1, one]]) + penalty * np.eye(2)
        move = np.linalg.solve(h, np.array([gx, g1]) + penalty * (b - [1.0, 0.0]))
        b -= move * min(1.0, 4 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def best_cuts(logits: DataFrame) -> dict[str, tuple[float, float | None, int]]:
    """By lang of (lang, logit, toxic): the logit from which on cutting gives the best F1, the next smaller one (None if there is none), and the number of toxic rows.

    Running counts come from ranges of (lang, logit) and what is before each of them, so no task holds a language.
    """
    spark = logits.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("lang"), F.col("logit").desc()]
    each = logits.groupBy("lang", "logit").agg(F.count("*").alias("n"), F.sum("toxic").alias("hit"))
    placed = stage(gathered(each.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), logits.count()), "cuts")
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part", "lang").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))  # a row for each range and language in it
    sums = sums.select("part", "lang", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "hit")], F.sum("hit").over(Window.partitionBy("lang")).alias("all"))
    within = Window.partitionBy("part", "lang").orderBy(F.col("logit").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.join(F.broadcast(sums), ["part", "lang"])
    f1 = 2 * (F.col("hit_before") + F.sum("hit").over(within)) / (F.col("n_before") + F.sum("n").over(within) + F.col("all"))
    best = running.select("lang", "logit", "all", f1.alias("f1")).groupBy("lang").agg(F.max(F.struct("f1", "logit"))["logit"].alias("cut"), F.max("all").alias("all"))
    best = stage(best, "best")  # a row for each language
    below = placed.join(F.broadcast(best), "lang").groupBy("lang", "cut", "all").agg(F.max(F.when(F.col("logit") < F.col("cut"), F.col("logit"))).alias("below"))
    found = {r.lang: (r.cut, r.below, r["all"]) for r in below.collect()}
    unstage(placed, best)
    return found


#: Bytes of the texts that a task trains on, about.
SHARD_BYTES = 8 << 20

#: Languages with fewer toxic documents for calibration share one threshold.
LEAST_TOXIC = 20


def held_out(key) -> F.Column:
    """Documents whose labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _among(documents: DataFrame, ids: DataFrame, bits: int = 1 << 27) -> DataFrame:
    """The documents whose id may be among ids: a bitmap of hashes (at most bits / 8 bytes are broadcast) spares others' texts the shuffle of a join."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    maps = ids.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("__map")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("__bits"))
    at = F.col("__place") % 32768
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.expr("(__place % 32768) div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = documents.withColumn("__place", place).withColumn("__map", F.expr("__place div 32768")).join(F.broadcast(maps), "__map")
    return held.filter(F.pmod(F.floor(byte / F.pow(F.lit(2.0), at % 8)), F.lit(2)) == 1).select(documents.columns)


def labelled(documents: DataFrame, labels: DataFrame, sample_bytes: int | None = None) -> tuple[DataFrame, np.ndarray, float]:
    """(doc_id, text, lang, toxic, place) of the documents whose labels may be learnt from, staged; the numbers of clean and toxic ids; the toxic share of the labels.

    place numbers the ids of a class: those divisible by 4 are for calibration. An id labelled more than once is toxic if any label
    says so; null labels are none. With sample_bytes only the documents with the smallest hashes of the id, up to that many bytes, count.
    """
    told = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = told.agg(F.avg("toxic")).head()[0]
    if sample_bytes is None:
        known = told.join(documents.select("doc_id"), "doc_id", "left_semi")
    else:
        sizes = documents.join(told, "doc_id").groupBy("doc_id", "toxic").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
        so_far = F.sum("bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        known = sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= sample_bytes).select("doc_id", "toxic")
    known = stage(gathered(known, labels.count()), "known")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    n = np.array([counts.get(0, 0), counts.get(1, 0)])
    placed = with_ranks(known, ["toxic", "doc_id"], "place", rows=int(n.sum())).withColumn("place", F.col("place") - F.when(F.col("toxic") == 1, F.lit(int(n[0]))).otherwise(0))
    texts = _among(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang"), known)
    held = stage(texts.join(placed.hint("merge"), "doc_id"), "labelled")  # the same plan at every size: ids are not bounded
    unstage(known)
    return held, n, float(share or 0.0)


def train(rows: DataFrame, buckets: int = 1 << 18, shard_bytes: int = SHARD_BYTES, dim: int = 8, widths: tuple[int, ...] = (1, 2, 3), filters: int = 8, least: int | None = None, share: int = 20,
          seed: int = 11, **steps) -> Network:
    """A network trained on all rows(doc_id, text, toxic, place).

    Counts by bucket are summed over all of them and give the start. Rows are dealt into shards of about `shard_bytes` of text, classes evenly; tasks improve the
    start on a shard each, and the mean of what they come to is the network (of a word's vector: over the shards that changed it).
    """
    spark = rows.sparkSession

    def count(batches):
        seen = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            seen += bucket_counts([t.encode() for t in batch.column(0).to_pylist()], batch.column(1).to_numpy(zero_copy_only=False), buckets)
        used = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[0, used]), pa.array(seen[1, used])], names=["bucket", "clean", "toxic"])

    counted = rows.select("text", "toxic").mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean"), F.sum("toxic")).toArrow()  # at most `buckets` rows
    seen = np.zeros((2, buckets), dtype=np.int64)
    for k in (0, 1):
        seen[k, counted.column(0).to_numpy()] = counted.column(k + 1).to_numpy()
    clean, toxic, size = rows.agg(F.sum(1 - F.col("toxic")), F.sum("toxic"), F.sum(F.octet_length("text"))).head()
    texts, shards = np.array([clean, toxic]), max(1, round(size / shard_bytes))
    net, used = start(seen, texts, dim, widths, filters, least, share, seed)
    shared, chunks = spark.sparkContext.broadcast((net, used, texts)), 256

    def improved(table: pa.Table) -> pa.Table:
        begin, used, texts = shared.value
        mine = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))), key=lambda r: r[:2])
        now = Network(begin.buckets, begin.embedding.copy(), [w.copy() for w in begin.filters], begin.bias.copy(), begin.output.copy(), begin.intercept)
        improve(now, used, texts, [t.encode() for _, t, _ in mine], np.array([t for *_, t in mine]), seed=seed, **steps)
        moved = np.flatnonzero((now.embedding != begin.embedding).any(axis=1))
        data = [np.concatenate([*(w.ravel() for w in now.filters), now.bias, now.output, [now.intercept]]).astype(np.float64).tobytes()]
        data += [own.astype(np.int32).tobytes() + (now.embedding[own] - begin.embedding[own]).tobytes() for own in (moved[moved % chunks == c] for c in range(chunks))]
        return pa.table({"part": pa.array(range(-1, chunks), pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()] * (chunks + 1), pa.int64()), "data": pa.array(data, pa.binary())})

    def mean(table: pa.Table) -> pa.Table:
        told = [d for _, d in sorted(zip(table.column("shard").to_pylist(), table.column("data").to_pylist()))]
        part = table.column("part")[0].as_py()
        if part < 0:
            data = (sum(np.frombuffer(d) for d in told) / len(told)).tobytes()
        else:
            total, times = np.zeros((buckets, dim)), np.zeros(buckets, dtype=np.int64)
            for d in told:
                n = len(d) // (4 + 4 * dim)
                at = np.frombuffer(d, np.int32, n)
                total[at] += np.frombuffer(d, np.float32, offset=4 * n).reshape(n, dim)
                times[at] += 1
            at = np.flatnonzero(times)
            data = at.astype(np.int32).tobytes() + (total[at] / times[at, None]).astype(np.float32).tobytes()
        return pa.table({"part": pa.array([part], pa.int32()), "data": pa.array([data], pa.binary())})

    dealt = rows.select("doc_id", "text", "toxic", F.pmod(F.floor(F.col("place") / 4) * 3 + F.col("place") % 4 - 1, F.lit(shards)).alias("shard"))
    each = dealt.groupBy("shard").applyInArrow(improved, "part int, shard long, data binary")
    for r in each.groupBy("part").applyInArrow(mean, "part int, data binary").collect():  # the size of a network, however many shards
        if r.part < 0:
            flat, at = np.frombuffer(r.data), 0
            for array in (*net.filters, net.bias, net.output):
                array[...] = flat[at:at + array.size].reshape(array.shape)
                at += array.size
            net.intercept = float(flat[at])
        else:
            n = len(r.data) // (4 + 4 * dim)
            net.embedding[np.frombuffer(r.data, np.int32, n)] += np.frombuffer(r.data, np.float32, offset=4 * n).reshape(n, dim)
    shared.unpersist()
    return net


def fit(documents: DataFrame, labels: DataFrame, sample_bytes: int | None = None, least_toxic: int = LEAST_TOXIC, **options) -> Network | float:
    """The network, or the toxic share of the labels (0 without any) where one of the classes is missing.

    Learns from all labelled documents that are not held out (up to `sample_bytes` of text, if a caller sets it). A quarter of each class is kept out of training
    and sets the scale of the score and the thresholds by language, again by all of its documents. Languages with fewer than
    `least_toxic` toxic documents in that quarter share a threshold.
    """
    held, n, share = labelled(documents, labels, sample_bytes)
    if min(n - -(-n // 4)) <= 0:
        unstage(held)
        return share
    net = train(held.filter("place % 4 <> 0"), **options)
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def logits(batches):
        for batch in batches:
            values = [shared.value.logits(raws) for _, raws in pieces(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(np.concatenate(values) if values else [], pa.float64())], names=["lang", "toxic", "logit"])

    told = stage(held.filter("place % 4 = 0").select("text", F.coalesce("lang", F.lit("")).alias("lang"), "toxic").mapInArrow(logits, "lang string, toxic int, logit double"), "calibration")
    unstage(held)
    net.scale = platt(told)
    # One set of cuts for all languages together, one for each.
    cuts = best_cuts(told.withColumn("lang", F.lit("")).union(told.select(F.concat(F.lit("="), "lang").alias("lang"), "toxic", "logit")).select("lang", "toxic", "logit"))
    unstage(told)
    for lang, (cut, below, hits) in sorted(cuts.items()):
        scores = _sigmoid(net.scale[0] * np.array([cut, cut if below is None else below]) + net.scale[1])
        threshold = float((scores[0] + (0.0 if below is None else scores[1])) / 2)
        if not lang:
            net.threshold = threshold
        elif hits >= least_toxic:
            net.thresholds[lang[1:]] = threshold
    return net


def score(documents: DataFrame, net: Network | float) -> DataFrame:
    """documents with a column __score: 0 to 1, higher for toxic. Null texts are scored like empty ones."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    if isinstance(net, float):
        return documents.withColumn("__score", F.lit(net))
    shared = documents.sparkSession.sparkContext.broadcast(net)
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            for k in range(0, batch.num_rows, 1024):
                values = [shared.value.scores(raws) for _, raws in pieces(texts.slice(k, 1024).to_pylist())]
                part = batch.slice(k, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(values), pa.float64())], names=[*batch.schema.names, "__score"])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField("__score", DoubleType())]))


def threshold_of(net: Network | float, lang) -> F.Column:
    """The threshold of a language; one for all others."""
    if isinstance(net, float):
        return F.lit(0.5)
    chosen = F.lit(net.threshold)
    for name, value in net.thresholds.items():
        chosen = F.when(F.coalesce(lang, F.lit("")) == name, F.lit(value)).otherwise(chosen)
    return chosen


def judge(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, rejected) of every document, repeated rows as often as they come.

    predicted is 1 from a score of 0.3; rejected compares with the threshold of the document's language. An empty or null
    text has the score of a text without words; a null id is not held out; further columns are not read.
    """
    net = fit(documents, labels, **options)
    scored = score(documents.select("doc_id", "lang", "text"), net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= 0.3).cast("int").alias("predicted"), (F.col("__score") >= threshold_of(net, F.col("lang"))).alias("rejected"))


def drop_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with all their columns, whatever their names.

    Null, empty and repeated texts are scored like any other; without labels of both classes every score is the toxic share of the labels. An
    empty table stays empty.
    """
    net = fit(documents, labels, **options)
    kept = documents.select(whole_row(documents).alias("row"), F.col("text").alias("text"), F.col("lang").alias("lang"))
    return score(kept, net).filter(F.col("__score") < threshold_of(net, F.col("lang"))).select("row.*")
