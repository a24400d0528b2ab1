"""Delete from documents the blocks of lines that an earlier document already holds.

A line hash alone is weak evidence where lines are short, so a line is taken together with as many of its neighbours as
carry `min_words` words: runs, as short as they can be, starting or ending at each line (a long line is a run of its
own). Documents are counted for each run. A run of two documents or more pairs each of them with its first holder (the smallest
id), which finds an earlier holder of every repeated block without listing all pairs of a run's documents.

Two documents that share a rare run (at most `rare` documents hold it) are compared whole. What only common runs link,
as a passage in a third of all documents does, is compared with an excerpt of the first holder, its common passages, for a
whole document is never sent to more than `rare` others for the sake of one run. Every pair is aligned by patience diff; aligned
blocks of at least `min_words` words are deleted from the later document, and so are further copies that it has of an aligned
block. Blocks that changed places cannot all be in one alignment, so what is left is aligned again until no block is found.
Nothing but these alignments deletes a line.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, gathered, hash_spans, mix, pieces, span_sums, stage, unstage, whole_row, word_spans

#: Documents that may hold a run for it to count as rare.
RARE = 100


def split_lines(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, words) of every line of several texts. Lines end at line feeds; white space at their ends does not count."""
    data = np.frombuffer(b"\n".join(raws), dtype=np.uint8)
    ends = np.r_[np.flatnonzero(data == 0x0A), len(data)]
    starts = np.r_[0, ends[:-1] + 1]
    count = np.array([r.count(b"\n") + 1 for r in raws])
    owners = np.repeat(np.arange(len(raws)), count)
    begin, finish = word_spans(data)
    first = np.searchsorted(begin, starts)
    last = np.searchsorted(begin, ends)
    words = last - first
    filled = words > 0
    hashes = np.zeros(len(starts), dtype=np.uint64)
    hashes[filled] = hash_spans(data, begin[first[filled]], finish[last[filled] - 1])
    return owners, hashes, words


def anchors(owners: np.ndarray, hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first line, last line + 1) of the shortest runs of lines with `least` words from and up to each line.

    Takes lines with words only, in order of their texts.
    """
    n = len(hashes)
    mixed = mix(hashes)
    total = np.r_[0, np.cumsum(words)]
    bound = np.searchsorted(owners, owners, side="right") if n else np.empty(0, int)
    start = np.searchsorted(owners, owners, side="left") if n else np.empty(0, int)
    s1 = np.arange(n)
    e1 = np.searchsorted(total, total[:-1] + least)
    ok = e1 <= bound
    e2 = np.arange(1, n + 1)
    s2 = np.searchsorted(total, total[1:] - least, side="right") - 1
    ok2 = (s2 >= start) & (total[1:] >= least)
    s, e = np.r_[s1[ok], s2[ok2]], np.r_[e1[ok], e2[ok2]]
    keys = mix(np.r_[span_sums(mixed, s1[ok], e1[ok]), span_sums(mixed, s2[ok2], e2[ok2])] + (e - s).astype(np.uint64))
    return keys, owners[s] if n else owners, s, e


def _line_batches(least: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for k in range(0, batch.num_rows, 2048):
                for first, raws in pieces(texts.slice(k, 2048).to_pylist()):
                    n = len(raws)
                    owners, hashes, words = split_lines(raws)
                    filled = np.flatnonzero(words)
                    keys, text, _, _ = anchors(owners[filled], hashes[filled], words[filled], least)
                    order = np.lexsort((keys, text))
                    keys, text = keys[order], text[order]
                    new = np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])][: len(keys)]
                    keys, text = keys[new], text[new]
                    count = np.searchsorted(owners, np.arange(n + 1))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c).slice(k + first, n) for c in (0, 2)]
                        + [pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.array(hashes.view(np.int64))),
                           pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.array(words.astype(np.int32))),
                           pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), pa.array(keys.view(np.int64)))],
                        names=["doc_id", "version", "hashes", "words", "anchors"])

    return run


def longest_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (ascending in the first) that ascends in the second too."""
    tails, at, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def patience(a: list, b: list, marks_a: list[tuple] | None = None, marks_b: list[tuple] | None = None) -> list[tuple[int, int]]:
    """Aligned line pairs of a and b by patience diff.

    Marks are (line, what it marks) in order, the lines themselves unless given; lines of one mark are equal. Those that are in either
    side's range just once are anchors. Their longest ascending chain is taken, every anchor with the equal lines that follow and precede it, and the
    ranges between are aligned in the same way. Where no mark is in both just once, the rarest one's first places are the
    anchor, and the ranges about it are cut by marks of the first kind alone.
    """
    p, q = (list(enumerate(own)) if marks is None else marks for own, marks in ((a, marks_a), (b, marks_b)))
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), True)]
    while todo:
        s, e, t, f, rarest = todo.pop()
        seen: dict[int, list[int]] = {}
        for j, mark in q[bisect_left(q, (t,)):bisect_left(q, (f,))]:
            seen.setdefault(mark, []).append(j)
        places: dict[int, list[int]] = {}
        for i, mark in p[bisect_left(p, (s,)):bisect_left(p, (e,))]:
            if mark in seen:
                places.setdefault(mark, []).append(i)
        pairs = sorted({(own[0], seen[mark][0]) for mark, own in places.items() if len(own) == 1 and len(seen[mark]) == 1})
        if not pairs and places and rarest:
            mark = min(places, key=lambda m: (len(places[m]) * len(seen[m]), places[m][0]))
            pairs, rarest = [(places[mark][0], seen[mark][0])], False
        chain = longest_chain(pairs)
        for k, (i, j) in enumerate(chain):
            if i < s:  # the lines after the last anchor reach beyond this one
                continue
            u, v = i, j
            while u > s and v > t and a[u - 1] == b[v - 1]:
                u, v = u - 1, v - 1
            if s < u and t < v:
                todo.append((s, u, t, v, rarest))
            s, t = i, j
            while s < e and t < f and a[s] == b[t]:
                while k < len(chain) and chain[k][0] < s:
                    k += 1
                if k < len(chain) and (s >= chain[k][0]) != (t >= chain[k][1]):
                    break  # the next anchor has a place of its own
                s, t = s + 1, t + 1
            out.extend(zip(range(u, s), range(v, t)))
        if chain and s < e and t < f:
            todo.append((s, e, t, f, rarest))
    return sorted(out)


def aligned_blocks(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last + 1) of the lines of the first side in runs of pairs that go on by one line on both sides."""
    out: list[tuple[int, int]] = []
    start, last = 0, (-2, -2)
    for i, j in pairs:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if last[0] >= 0:
                out.append((start, last[0] + 1))
            start = i
        last = (i, j)
    return [*out, (start, last[0] + 1)] if pairs else out


def repeated_lines(x: list, words: list, own: list[tuple], y: list, theirs: list[tuple], least: int) -> list[tuple[int, int]]:
    """Blocks (first, last + 1) of x of at least `least` words that align with y, and further copies of such blocks in x.

    x and y are hashes of lines with words, own and theirs their runs (first, last + 1, key). The marks of an alignment are the runs that both
    have and that are not wholly deleted yet, so every round deletes some.
    """
    known = {key for _, _, key in theirs}
    shared = [run for run in own if run[2] in known]
    if not shared:
        return []
    wanted = {key for _, _, key in shared}
    marks_y = sorted({(t, key) for t, _, key in theirs if key in wanted})
    total = [0, *accumulate(words)]
    gone, blocks = bytearray(2 * len(x)), []  # a line, then the gap after it
    live = shared
    while live:
        found = [(s, e) for s, e in aligned_blocks(patience(x, y, sorted({(s, key) for s, _, key in live}), marks_y)) if total[e] - total[s] >= least]
        starts = [s for s, _ in found]
        inside = set()
        for s, e, key in own:
            k = bisect_right(starts, s) - 1
            if k >= 0 and e <= found[k][1]:
                inside.add(key)
        found += [(s, e) for s, e, key in own if key in inside]
        for s, e in found:
            gone[2 * s:2 * e - 1] = b"\x01" * (2 * (e - s) - 1)
        blocks += found
        before, live = len(live), [run for run in live if 0 in gone[2 * run[0]:2 * run[1] - 1]]
        if len(live) == before:
            break
    return blocks


class _Side:
    """The lines with words of each row of two list columns (hashes, word counts), and their runs."""

    def __init__(self, hashes, words, least: int):
        flat, self.lengths = words.flatten().to_numpy(zero_copy_only=False), words.value_lengths().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(flat)
        first = np.cumsum(np.r_[0, self.lengths])
        owners = np.repeat(np.arange(len(words)), self.lengths)[at]
        x, w = hashes.flatten().to_numpy(zero_copy_only=False)[at], flat[at]
        keys, text, s, e = anchors(owners, x.view(np.uint64), w, least)
        order = np.argsort(text, kind="stable")
        rows = np.arange(len(words) + 1)
        self.at, self.runs_at = np.searchsorted(owners, rows), np.searchsorted(text[order], rows)
        self.x, self.w, self.place = x.tolist(), w.tolist(), at - first[owners]
        self.runs = list(zip((s - self.at[text])[order].tolist(), (e - self.at[text])[order].tolist(), keys[order].tolist()))

    def row(self, k: int) -> tuple[slice, list[tuple]]:
        return slice(self.at[k], self.at[k + 1]), self.runs[self.runs_at[k]:self.runs_at[k + 1]]


def repeated_in_pairs(a, wa, b, wb, least: int) -> list[np.ndarray]:
    """For each row of list columns (hashes and word counts of the lines of two documents): the lines of the first (numbers from 0) in blocks that
    align with the second. Lines without words are passed over; those within a block go with it."""
    one, two = _Side(a, wa, least), _Side(b, wb, least)
    out = []
    for k in range(len(a)):
        (own, runs), (other, theirs) = one.row(k), two.row(k)
        blocks = repeated_lines(one.x[own], one.w[own], runs, two.x[other], theirs, least)
        if blocks:
            s, e = np.array(blocks).T
            place = one.place[own]
            out.append(np.flatnonzero(_covered(int(one.lengths[k]), place[s], place[e - 1] + 1)))
        else:
            out.append(np.empty(0, np.int64))
    return out


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def _rows(column) -> list[np.ndarray]:
    """The lists of a column as views."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.r_[0, column.value_lengths().to_numpy(zero_copy_only=False)])
    return [flat[s:e] for s, e in zip(ends[:-1], ends[1:])]


def _align_batches(least: int):
    def run(batches):
        for batch in batches:
            found = repeated_in_pairs(*(batch.column(c) for c in (2, 3, 4, 5)), least)
            keep = np.flatnonzero([len(f) for f in found])
            rows, ends = pa.array(keep, pa.int64()), np.cumsum(np.r_[0, [len(found[k]) for k in keep]])
            flat = np.concatenate([found[k] for k in keep] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))],
                                             names=["doc_id", "version", "lines"])

    return run


def _excerpt_batches(least: int):
    """(first_id, hashes, words) of documents' lines in any of the runs `common`; what is left out between them is one line that no document has."""
    def run(batches):
        for batch in batches:
            ids, hashes, words = [], [], []
            for k, (h, w, common) in enumerate(zip(*(_rows(batch.column(c)) for c in (1, 2, 3)))):
                at = np.flatnonzero(w)
                keys, _, s, e = anchors(np.zeros(len(at), np.int64), h[at].astype(np.int64, copy=False).view(np.uint64), w[at], least)
                held = np.isin(keys, common.astype(np.int64, copy=False).view(np.uint64))
                inside = _covered(len(at), s[held], e[held])
                keep = inside | np.r_[False, inside[:-1]][: len(inside)]  # and the line after each passage, which becomes the gap
                ids.append(k)
                hashes.append(np.where(inside, h[at], 0)[keep])
                words.append(np.where(inside, w[at], 1)[keep])
            ends = pa.array(np.cumsum(np.r_[0, [len(h) for h in hashes]]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*hashes, np.empty(0, np.int64)]))),
                                              pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*words, np.empty(0, np.int32)]).astype(np.int32)))], names=["first_id", "b", "wb"])

    return run


def repeated_blocks(documents: DataFrame, min_words: int = 25, rare: int = RARE) -> DataFrame:
    """(doc_id, version, lines): the line numbers to delete in order, for documents that have any.

    version is the text's hash, so rows that share an id are told apart; they are never compared with each other.
    """
    id_type = dict(documents.dtypes)["doc_id"]
    known = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("version"))
    told = stage(known.mapInArrow(_line_batches(min_words), f"doc_id {id_type}, version long, hashes array<long>, words array<int>, anchors array<long>")
                 .filter(F.size("anchors") > 0), "lines")
    held = told.select("doc_id", "version", F.explode("anchors").alias("anchor"))
    first = (held.groupBy("anchor").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("_last"), F.count("*").alias("n")).filter("first_id <> _last")
             .select("anchor", "first_id", (F.col("n") > rare).alias("common")))
    n_rows, n_anchors = told.agg(F.count("*"), F.coalesce(F.sum(F.size("anchors")), F.lit(0))).head()
    first = stage(gathered(first, n_anchors // 2), "anchors")  # each is in two documents at least
    # A pair that a rare run links is compared whole, whatever common runs it has.
    pairs = held.join(first, "anchor").filter("doc_id <> first_id").groupBy("doc_id", "version", "first_id").agg(F.min("common").alias("common"))
    later = told.select("doc_id", "version", F.col("hashes").alias("a"), F.col("words").alias("wa"))
    passages = first.filter("common").groupBy("first_id").agg(F.collect_list("anchor").alias("passages"))  # no more than the document has
    excerpts = (told.join(passages, F.col("doc_id") == F.col("first_id")).select("first_id", "hashes", "words", "passages")
                .mapInArrow(_excerpt_batches(min_words), f"first_id {id_type}, b array<long>, wb array<int>"))
    whole = told.select(F.col("doc_id").alias("first_id"), F.col("hashes").alias("b"), F.col("words").alias("wb"))
    sooner = stage(whole.withColumn("common", F.lit(False)).union(excerpts.withColumn("common", F.lit(True))), "sooner")
    full = pairs.join(later, ["doc_id", "version"]).join(sooner, ["first_id", "common"]).select("doc_id", "version", "a", "wa", "b", "wb")
    found = full.mapInArrow(_align_batches(min_words), f"doc_id {id_type}, version long, lines array<int>")
    merged = found.select("doc_id", "version", F.explode("lines").alias("line")).groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    out = stage(gathered(merged, n_rows), "blocks")
    unstage(first, told, sooner)
    return out


def _edited(documents: DataFrame, min_words: int, rare: int) -> DataFrame:
    """(row, text, removed): each row as it came, its text without the repeated blocks, and their line numbers (null for none)."""
    blocks = repeated_blocks(documents, min_words, rare).select(F.col("doc_id").alias("id"), "version", F.col("lines").alias("removed"))
    rows = documents.select(whole_row(documents).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    joined = rows.join(blocks.hint("shuffle_hash"), (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("version")), "left")  # the same plan at every size
    # The stretches of lines between the removed ones, cut from the text's lines in one go.
    after = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("removed", k - 1) + 1)
    stretches = F.filter(F.transform(F.sequence(F.lit(0), F.size("removed")), lambda k: F.struct(after(k).alias("s"), F.coalesce(F.get("removed", k), F.lit(2**31 - 1)).alias("e"))), lambda r: r["s"] < r["e"])
    left = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.array_join(F.flatten(F.transform(stretches, lambda r: F.slice(lines, r["s"] + 1, r["e"] - r["s"]))), "\n"))
    return joined.select("row", F.when(F.col("removed").isNotNull(), left[0]).otherwise(F.col("text")).alias("text"), "removed")


def _columns(documents: DataFrame, **changed: F.Column) -> list:
    return [changed.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns]


def dedup_lines(documents: DataFrame, min_words: int = 25, rare: int = RARE) -> DataFrame:
    """documents with repeated blocks deleted from `text`, all other columns as they are, whatever their names.

    The earliest document (smallest id) that holds a line of a block keeps it. Null texts, empty texts and rows without an
    id stay as they are; repeated rows are edited alike; an empty table stays empty.
    """
    return _edited(documents, min_words, rare).select(*_columns(documents, text=F.col("text")))


def line_report(documents: DataFrame, min_words: int = 25, rare: int = RARE) -> DataFrame:
    """(doc_id, n_lines, removed, text) of every row: lines it had (0 for a null text), the numbers of those deleted, the text that is left.

    Rows, nulls and an empty table are treated as by dedup_lines(); other columns are not read.
    """
    before = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    base = documents.select("doc_id", "text", before.cast("int").alias("n_lines"))
    return _edited(base, min_words, rare).select("row.doc_id", "row.n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), "text")


def drop_repeated(documents: DataFrame, min_words: int = 25, rare: int = RARE, least_share: float = 0.0) -> DataFrame:
    """The documents with repeated blocks deleted (n_chars follows, if there is one), without those that nothing is left of.

    With `least_share`, a document that keeps less than this share of its words is a copy but for scraps, and goes too. Rows that nothing is
    deleted from stay, empty and null texts among them; an empty table stays empty.
    """
    words = lambda text: F.regexp_count(text, F.lit(WORD))
    edited = _edited(documents, min_words, rare)
    kept = words(F.col("text"))
    edited = edited.filter(F.col("removed").isNull() | ((kept > 0) & (kept >= F.lit(least_share) * words(F.col("row.text")))))
    changed = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        kind = dict(documents.dtypes)["n_chars"]
        changed["n_chars"] = F.when(F.col("removed").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(kind))
    return edited.select(*_columns(documents, **changed))
