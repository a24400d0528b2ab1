"""Pack tokenised documents into sequences of a fixed length by the sum-of-squares rule.

A document's tokens are cut into full windows and a rest. The rest goes into the partially filled window
whose choice makes the sum of squared counts of windows by fill level smallest; the counts are one array
over the levels. Where a task's documents end, windows that are still open fill each other up by cutting,
so at most one window per task is padded. Each task packs its own rows as they stream by: no shuffle, and
memory is one open window per piece that waits plus the batch at hand.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: The id that ends a document.
END = 1


#: How a byte-level tokenizer cuts a text before it merges (fixed by the format).
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """Token ids of texts, by a tokenizers file.

    A plain byte-level BPE file whose merges come in the order of their ids says exactly what a rank table
    says; such a file is handed to tiktoken's faster merging, special tokens included. Any other file goes to tokenizers itself,
    and so does, whole, a text that tiktoken refuses (its cutting gives up on about a million white-space characters in a row).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        ranks = self._ranks(said)
        self.fast = None
        if ranks is not None:
            import tiktoken

            special = {t["content"]: t["id"] for t in said["added_tokens"]}
            self.fast = tiktoken.Encoding("from-file", pat_str=CUT, mergeable_ranks=ranks, special_tokens=special)

    @staticmethod
    def _ranks(said: dict) -> dict[bytes, int] | None:
        model, before = said["model"], said.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
                 and said.get("normalizer") is None and said.get("post_processor") is None and before.get("type") == "ByteLevel"
                 and not before.get("add_prefix_space") and before.get("use_regex", True)
                 and not any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")))
        if not plain:
            return None
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that the file shows as themselves
        of = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"] for t in said["added_tokens"]}
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [v for k, v in sorted(vocab.items(), key=lambda x: x[1]) if len(k) > 1] != [vocab.get(m) for m in merges]:
            return None
        ranks = {bytes(of[c] for c in k): v for k, v in vocab.items()}
        return ranks if all(bytes([b]) in ranks for b in range(256)) else None

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except ValueError:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


class Packer:
    """Places pieces (tag, length) into windows of `size`; emits (tag, sequence, offset, cut, length)."""

    def __init__(self, size: int, first: int = 0):
        self.size, self.next = size, first
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list] = [[] for _ in range(size + 1)]

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def whole(self) -> int:
        """A sequence of its own, full at once."""
        return self._new()

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece shorter than a window.

        A window that leaves level a changes the sum of squares by 1 - 2n[a], one that comes to level b by
        2n[b] + 1 (levels 0 and full count nothing). The smallest change wins, then the fullest window.
        """
        count, size = self.count, self.size
        gain = np.zeros(size - length + 1, dtype=np.int64)  # by the level a that the window has now
        gain[:-1] += 2 * count[length:size] + 1
        gain[1:] += 1 - 2 * count[1:size - length + 1]
        gain[1:][count[1:size - length + 1] == 0] = np.iinfo(np.int64).max
        level = len(gain) - 1 - int(np.argmin(gain[::-1]))
        if level:
            sequence = self.open[level].pop()
            count[level] -= 1
        else:
            sequence = self._new()
        if level + length < size:
            self.open[level + length].append(sequence)
            count[level + length] += 1
        return sequence, level


def pack_ids(documents: Iterator[tuple[object, np.ndarray]], size: int, first: int) -> Iterator[tuple]:
    """Rows of SCHEMA for (doc_id, ids with the end id) pairs, sequences numbered from `first`.

    Pieces of open windows are kept back until their window is full; then all its rows are emitted.
    """
    packer = Packer(size, first)
    held: dict[int, list] = {}
    for doc, ids in documents:
        n = len(ids)
        at = 0
        while n - at >= size:
            yield doc, at, size, zlib.crc32(ids[at:at + size]), n, packer.whole(), 0
            at += size
        if at < n:
            sequence, offset = packer.place(n - at)
            pieces = held.setdefault(sequence, [])
            pieces.append((doc, at, ids[at:].copy(), n))
            if offset + n - at == size:
                yield from _window(held.pop(sequence), sequence)
    # What is left: the fullest windows are filled up from the emptiest, which are cut.
    rest = [(level, s) for level in range(size, 0, -1) for s in packer.open[level]]
    pool = [piece for _, s in rest for piece in held.pop(s)]
    sequence, window, filled = None, [], 0
    for doc, at, ids, n in pool:
        while len(ids):
            if not window:
                sequence = packer.whole()
            part = ids[:size - filled]
            window.append((doc, at, part, n))
            at, ids, filled = at + len(part), ids[len(part):], filled + len(part)
            if filled == size:
                yield from _window(window, sequence)
                window, filled = [], 0
    if window:
        yield from _window(window, sequence)


def _window(pieces: list, sequence: int) -> Iterator[tuple]:
    offset = 0
    for doc, at, ids, n in pieces:
        yield doc, at, len(ids), zlib.crc32(np.ascontiguousarray(ids)), n, sequence, offset
        offset += len(ids)


_tokens: dict[str, Tokens] = {}


def pack_documents(documents: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """One row per piece of every document (SCHEMA). `tokenizer` is the path of a tokenizers file on every machine.

    A null or empty text is the end id alone; null ids and repeated rows are documents like any other;
    an empty table gives no rows. Columns beyond doc_id and text are not read. Sequence ids are
    those of the task shifted by 40 bits plus a count, so they are unique without a shuffle and a
    repeated task gives the same rows.
    """

    def pack(batches):
        if tokenizer not in _tokens:
            _tokens[tokenizer] = Tokens(tokenizer)
        encode = _tokens[tokenizer].encode
        end = np.array([END], dtype="<u4")

        def tokenised():
            for batch in batches:
                texts = batch.column(1)
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    yield doc, np.concatenate([encode(texts[k].as_py() or ""), end])

        first = TaskContext.get().partitionId() << 40
        yield from _batches(pack_ids(tokenised(), size, first))

    return documents.select("doc_id", "text").mapInArrow(pack, SCHEMA)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = [part.split(" ")[0] for part in SCHEMA.split(", ")]
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
