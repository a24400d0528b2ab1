"""What the operators of this subpackage share: staged tables, word hashing and components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..sources.staging import delete_at_end, gathered, new_path, stage, unstage

__all__ = ["delete_at_end", "gathered", "new_path", "stage", "unstage"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes that Python workers are sent at a time. Larger batches are no faster, and a worker holds several copies of one.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers and bound the batches that they get, unless the session has a smaller bound."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(name).lower()
    if not said.rstrip("b").isdigit() or int(said.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, whatever their names, so that no name of ours can clash with them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


# --- hashing -------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_PIECE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = 1 << 16
_UP = np.cumprod(np.r_[np.uint64(1), np.full(_STEP - 1, _BASE, dtype=np.uint64)])
_DOWN = np.cumprod(np.r_[np.uint64(1), np.full(_STEP - 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)])


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, plus: int = 0) -> np.ndarray:
    """For spans with ascending starts and ascending ends: the sum over values[start:end] of (value + plus) * base**(place in the span).

    One running polynomial sum, of which a block is held at a time.
    """
    if len(values) < _STEP:
        sums = np.empty(len(values) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((values.astype(np.uint64) + np.uint64(plus)) * _UP[: len(values)], out=sums[1:])
        return (sums[ends] - sums[starts]) * _DOWN[starts]
    blocks = len(values) // _STEP + 1
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(blocks - 1, pow(base, _STEP, 1 << 64), dtype=np.uint64)]) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
    low, high, carry = np.empty(len(starts), dtype=np.uint64), np.empty(len(ends), dtype=np.uint64), np.uint64(0)
    for k in range(blocks):
        at = k * _STEP
        block = values[at:at + _STEP].astype(np.uint64)
        sums = np.empty(len(block) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((block + np.uint64(plus)) * _UP[: len(block)], out=sums[1:])
        sums *= up[k]
        sums += carry
        for places, out in ((starts, low), (ends, high)):
            s, e = np.searchsorted(places, [at, at + _STEP])
            out[s:e] = sums[places[s:e] - at]
        carry = sums[-1]
    return (high - low) * _DOWN[starts % _STEP] * down[starts // _STEP]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans, starts and ends ascending."""
    return mix(span_sums(data, starts, ends, 1) + (ends - starts).astype(np.uint64) * _ODD)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(texts: list, limit: int = _PIECE):
    """Cut texts (str, bytes or None) into batches of about `limit` bytes, each a (first, bytes list) pair."""
    batch, first, size = [], 0, 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text if isinstance(text, bytes) else text.encode()
        if batch and size + len(raw) > limit:
            yield first, batch
            batch, first, size = [], i, 0
        batch.append(raw)
        size += len(raw) + 1
    if batch:
        yield first, batch


def hash_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of several texts, and the text that each word is in."""
    if sum(map(len, raws)) > 2 * _PIECE:  # one very long text: in parts cut at white space, so memory stays bounded
        hashes, owners = [], []
        for k, raw in enumerate(raws):
            at = 0
            while at < len(raw):
                end = min(len(raw), at + _PIECE)
                while end < len(raw) and not _SPACE[raw[end]]:
                    end += 1
                h, _ = hash_words([raw[at:end]]) if end - at <= 2 * _PIECE else _hash_words([raw[at:end]])
                hashes.append(h)
                owners.append(np.full(len(h), k, dtype=np.int64))
                at = end
        return np.concatenate(hashes or [np.empty(0, np.uint64)]), np.concatenate(owners or [np.empty(0, np.int64)])
    return _hash_words(raws)


def _hash_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(raws).lower(), dtype=np.uint8)
    starts, ends = word_spans(data)
    bounds = np.cumsum([len(r) + 1 for r in raws])
    return hash_spans(data, starts, ends), np.searchsorted(bounds, starts, side="right")


def hash_shingles(words: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words within a text; a text of fewer words gives its whole sequence as one."""
    if not len(words):
        return words, owners
    last = np.r_[owners[1:] != owners[:-1], True]
    first = np.r_[True, last[:-1]]
    begin = np.flatnonzero(first)
    count = np.diff(np.r_[begin, len(words)])
    position = np.arange(len(words)) - np.repeat(begin, count)
    left = np.repeat(count, count) - position
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(n):
        shifted = np.zeros(len(words), dtype=np.uint64)
        shifted[: max(0, len(words) - k)] = words[k:]
        total = np.where(left > k, mix((total + np.uint64((int(_ODD) * (k + 1)) % 2**64)) ^ shifted), total)
    keep = (left >= n) | ((position == 0) & (left < n))
    return mix(total ^ np.minimum(left, n).astype(np.uint64))[keep], owners[keep]


# --- connected components ------------------------------------------------------------------

#: Links that a task writes, about.
LINKS = 20_000


def components(edges: DataFrame, left: str, right: str, limit: int = 60) -> DataFrame:
    """(id, component) of every endpoint: component is the smallest id that links reach.

    Alternates large-star and small-star steps (neighbours move to the smallest neighbour) until
    nothing changes. Every round is two shuffles of the link table, staged in the shared folder;
    nothing is collected but the count and checksum of the links. The result is staged. Rounds write files of
    about `LINKS` links where adaptive execution leaves their shuffles in many small partitions.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    few = lambda links, rows: links.coalesce(max(cores, -(-rows // LINKS)))
    now = stage(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter("u <> v").distinct(), "links")
    before = None
    for _ in range(limit):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if seen == before or not seen[0]:
            break
        before = seen
        both = now.union(now.select("v", "u").toDF("u", "v"))
        large = _star(both, larger=True)
        small = stage(few(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), larger=False), seen[0]), "links")
        unstage(now)
        now = small
    else:
        raise RuntimeError("components did not settle")
    root = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    found = stage(few(now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(root.distinct()), 2 * seen[0]), "components")
    unstage(now)
    return found


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """One step: link the neighbours of u (the larger ones, or the smaller ones and u) to its smallest neighbour.

    The minimum is kept under a complemented key, so that the join back deals both sides anew and a
    hub's links can be split among tasks.
    """
    least = (pairs.groupBy(F.bitwise_not("u").alias("_n")).agg(F.min("v").alias("_m"))
             .select(F.bitwise_not("_n").alias("u"), "_m"))
    joined = pairs.join(least, "u")
    low = F.least("u", "_m")
    if larger:
        return joined.filter("v > u").select(F.col("v").alias("u"), low.alias("v")).distinct()
    out = joined.select(F.col("v").alias("u"), F.col("_m").alias("v"))
    own = least.select("u", F.col("_m").alias("v"))
    return out.union(own).filter("u <> v").distinct()
