"""Packing of token sequences by best-fit decreasing.

Every document becomes token ids (a fixed vocabulary file, whole text) and a closing id. Documents over the window
are cut into full windows first, each a sequence of its own; the rest of them and all shorter documents are packed by
best-fit decreasing: longest piece first, into the open window with the least room that still holds it. The tightest
window is found in a segment tree indexed by remaining capacity, which tells the smallest capacity with an open
window at or above a length in O(log window) steps.

A task packs what its own partition of the table holds, in blocks of up to BLOCK pieces: nothing is shuffled, memory
is bounded by a block, and a task that is run again gives the same pieces. A block leaves at most a few windows less
than full, of thousands.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed as often as they occur; a null
doc_id is kept; an empty table gives an empty result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import contextlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lexiform.llm.common import table

WINDOW = 2048
END_ID = 1
#: Pieces packed together.
BLOCK = 65_536
#: Whitespace-delimited strings whose ids a worker remembers.
REMEMBERED = 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Fixed values of the vocabulary file's format: how a text is cut before merges, and what ends a word.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


@cache
def unassigned() -> re.Pattern:
    """Code points without a category in Python's tables; the tokenizer's may be newer and know them."""
    names = "".join("x" if unicodedata.category(chr(i)) == "Cn" else " " for i in range(0x110000))
    return re.compile("[" + "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in regex.finditer("x+", names)) + "]")


class Unknown(ValueError):
    """A string with a character that Python's tables lack."""


class WordTokenizer:
    """Ids of the word vocabulary, as little-endian 32-bit bytes, with a memory of frequent strings.

    No merge crosses white space, so a text's ids are those of its strings between white space. A string's ids come
    from a byte-pair encoder with the vocabulary's ranks, in which a word's end is a byte of its own that merges first.
    Texts with characters that the vocabulary's normalisation treats by context, or that Python's tables lack, go
    through the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        added = set(self.whole.get_added_tokens_decoder())
        byte_of = {c: b for b, c in _byte_chars().items()}
        self.end = b"\x00"
        ranks, self.ids = {bytes([b]): b for b in range(256)}, {}
        for token, i in vocab.items():
            if i not in added:
                stem = token.removesuffix(WORD_END)
                raw = bytes(byte_of[c] for c in stem) + (self.end if stem != token else b"")
                ranks.setdefault(raw, 256 + i)
                self.ids[ranks[raw]] = i.to_bytes(4, "little")
        self.piece = tiktoken.Encoding("words", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(PIECES)
        self.unassigned = unassigned().search
        self.known: dict[str, bytes] = {}

    def string(self, s: str) -> bytes:
        if not s.isascii() and self.unassigned(s):
            raise Unknown(s)
        one = self.ids.__getitem__
        parts = (s,) if s.isalpha() else self.pieces.findall(s)
        got = b"".join([one(x) for p in parts for x in self.piece(p.encode() + self.end)])
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[s] = got
        return got

    def text(self, text: str) -> bytes:
        if not ("<|" in text or "Σ" in text or "\x00" in text or any(c in text for c in "\x1c\x1d\x1e\x1f") or not (text.isascii() or unicodedata.is_normalized("NFC", text))):
            known, string = self.known.get, self.string
            with contextlib.suppress(Unknown):
                return b"".join([known(s) or string(s) for s in text.lower().split()])
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and the offset in it of every length (1 to window), and the number of bins."""
    size = 1 << window.bit_length()
    tree = [False] * (2 * size)  # node 2k or 2k + 1 holds an open window; leaf size + c: one with room c
    with_room: list[list[int]] = [[] for _ in range(window + 1)]
    used: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = size + need
        if not tree[at]:  # climb until a right sibling has something, then go down to its leftmost leaf
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at > 1:
                at += 1
                while at < size:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
        if at > 1:
            room = at - size
            b = with_room[room].pop()
            if not with_room[room]:
                _mark(tree, at, False)
        else:
            room, b = window, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += need
        room -= need
        if room:
            if not with_room[room]:
                _mark(tree, size + room, True)
            with_room[room].append(b)
    return bins, offsets, len(used)


def _mark(tree: list[bool], leaf: int, open_: bool) -> None:
    tree[leaf] = open_
    at = leaf >> 1
    while at:
        now = tree[2 * at] or tree[2 * at + 1]
        if tree[at] == now:
            break
        tree[at] = now
        at >>= 1


class _Block:
    """Pieces gathered for one best-fit run."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def batches(self, first: int, window: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([r[2] for r in self.rows], np.int64)
        bins, offsets, n = best_fit_decreasing(lengths, window)
        cols = list(zip(*self.rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array(bins + first), pa.array(offsets)]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), n


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for every piece of every document: where it starts, its checksum, and its place in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end, block = tokenizer(tokenizer_path), end_id.to_bytes(4, "little"), _Block()
        sequence = TaskContext.get().partitionId() << 40  # no other task numbers sequences from here
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = tok.text(text.as_py() or "") + end
                n = len(raw) // 4
                for start in range(0, n, window):
                    part = raw[4 * start : 4 * (start + window)]
                    block.rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            while len(block.rows) >= BLOCK:
                whole, block = block, _Block()
                out, used = whole.batches(sequence, window)
                sequence += used
                yield out
        if block.rows:
            yield block.batches(sequence, window)[0]

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
