"""Byte-level byte-pair encoding.

Splitting and the byte alphabet are Spark expressions; only the merge loop is Python, an Arrow UDF over a text's
pre-tokens that remembers what it merged, so no token is shuffled. A model's vocabulary and merges are read to the driver
behind a check of their number and shipped once to each executor.

Defined cases: a null text has null ids, an empty one no ids; a text with a symbol that the vocabulary lacks, where no
unknown token is defined, has null ids from tokenize().
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiform.functions import text as T

# Bytes that stand for themselves; every other byte is, in order, a character from U+0100 on.
PRINTABLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
# Blanks, and the pre-token pattern over them.
BLANKS = r"\t\n\f\r\p{Z}"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANKS}\p{{L}}\p{{N}}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
# Special tokens that are found anywhere in a text.
SPECIALS = ("<s>", "</s>", "<mask>", "<pad>", "<unk>")
MASK = "<mask>"

OTHER_BYTES = "".join(chr(b) for b in range(256) if b not in PRINTABLE)
OTHER_CHARS = "".join(chr(0x100 + i) for i in range(len(OTHER_BYTES)))
#: Vocabulary or merge rows of a model that the driver takes; more is an error.
MODEL_ROWS = 5_000_000
#: Pre-tokens a task remembers.
REMEMBERED = 500_000


def byte_encode(c: Column) -> Column:
    """Each UTF-8 byte as a printable character."""
    return F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), OTHER_BYTES, OTHER_CHARS)


def byte_decode(c: Column) -> Column:
    """The text whose bytes the characters stand for; cut-off UTF-8 sequences become U+FFFD."""
    known = F.regexp_replace(F.translate(c, OTHER_CHARS[1:], OTHER_BYTES[1:]), OTHER_CHARS[0], "\x00")
    return F.make_valid_utf8(F.encode(known, "ISO-8859-1").cast("string"))


def special_split(c: Column, specials: tuple[str, ...] = SPECIALS) -> Column:
    """Special tokens and the runs between them; a run before the mask loses its blanks at the end."""
    pattern = "|".join(specials)
    if MASK in specials:
        c = F.regexp_replace(c, rf"(?<![{T.BLANK}])[{T.BLANK}]++(?={MASK})", "")
    return F.regexp_extract_all(c, F.lit(f"(?s){pattern}|(?:(?!{pattern}).)+"), F.lit(0))


def pre_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PRE_TOKEN), F.lit(0))


@dataclass
class Bpe:
    """A vocabulary with merges as (rank, merged id) by pair of ids."""

    ids: dict[str, int]
    ranks: dict[tuple[int, int], tuple[int, int]]
    unk: str | None = None
    fuse_unk: bool = True
    prefix: str = ""
    suffix: str = ""
    names: dict[int, str] = field(init=False)

    def __post_init__(self) -> None:
        self.names = {i: t for t, i in self.ids.items()}

    def symbols(self, word: str) -> list[int]:
        """Ids of a word's characters; unknown ones become the unknown id, runs of it one where fused, or are left out."""
        return [i for i, _, _ in self.symbol_spans(word)]

    def symbol_spans(self, word: str) -> list[tuple[int, int, int]]:
        """(id, begin, stop) of the symbols, in characters; a fused unknown one spans its run."""
        out: list[tuple[int, int, int]] = []
        unk = self.ids.get(self.unk) if self.unk is not None else None
        last_unknown = False
        for n, char in enumerate(word):
            got = self.ids.get((self.prefix if n else "") + char + (self.suffix if n == len(word) - 1 else ""))
            if got is None and unk is not None and not (self.fuse_unk and last_unknown):
                out.append((unk, n, n + 1))
            elif got is not None:
                out.append((got, n, n + 1))
            elif unk is not None:
                out[-1] = (unk, out[-1][1], n + 1)
            last_unknown = got is None
        return out

    def merge(self, word: str, dropout: float = 0.0, seed: int = 0) -> list[int]:
        """Ids after all merges, lowest rank first and leftmost among equals; with dropout, merges are skipped at random."""
        return [i for i, _, _ in self.spans(word, dropout, seed)]

    def spans(self, word: str, dropout: float = 0.0, seed: int = 0) -> list[tuple[int, int, int]]:
        """(id, begin, stop) after all merges, in characters of the word."""
        found = self.symbol_spans(word)
        at, stops = [i for i, _, _ in found], [stop for _, _, stop in found]
        n = len(at)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int, int]] = []
        skipped: list[tuple[int, int, int, int, int]] = []
        chance = random.Random(zlib.crc32(word.encode("utf-8", "surrogatepass")) ^ seed)

        def offer(i: int) -> None:
            if i >= 0 and following[i] < n:
                pair = at[i], at[following[i]]
                if pair in self.ranks:
                    heappush(queue, (self.ranks[pair][0], i, *pair, self.ranks[pair][1]))

        for i in range(n - 1):
            offer(i)
        while queue:
            top = heappop(queue)
            if dropout and chance.random() < dropout:
                skipped.append(top)
                continue
            for s in skipped:
                heappush(queue, s)
            skipped.clear()
            _, i, a, b, merged = top
            j = following[i]
            if at[i] != a or j >= n or at[j] != b:
                continue  # one of the two was merged elsewhere
            at[i], at[j], stops[i] = merged, -1, stops[j]
            following[i] = following[j]
            if following[j] < n:
                before[following[j]] = i
            offer(before[i])
            offer(i)
        return [(x, begin, stop) for x, (_, begin, _), stop in zip(at, found, stops) if x != -1]


def model(vocab: DataFrame, merges: DataFrame, unk: str | None = None, fuse_unk: bool = True, prefix: str = "", suffix: str = "") -> Bpe:
    """A Bpe from (token, id) and (rank, left, right); ranks are ordinals, and all three tokens of a merge must exist."""
    for name, df in (("vocabulary", vocab), ("merges", merges)):
        if (n := df.count()) > MODEL_ROWS:
            raise ValueError(f"{name} of {n} rows; at most {MODEL_ROWS}")
    ids = {r["token"]: r["id"] for r in vocab.select("token", "id").collect()}
    ranks: dict[tuple[int, int], tuple[int, int]] = {}
    for n, r in enumerate(merges.orderBy("rank").select("left", "right").collect()):
        left, right = r["left"], r["right"]
        whole = left + right.removeprefix(prefix)
        if missing := [t for t in (left, right, whole) if t not in ids]:
            raise ValueError(f"merge {n} names tokens that the vocabulary lacks: {missing}")
        ranks[ids[left], ids[right]] = (n, ids[whole])
    return Bpe(ids, ranks, unk, fuse_unk, prefix, suffix)


def token_spans(words: Column, model: Bpe) -> Column:
    """(token, id, begin, stop) of an array of words, in order, in characters of the words one behind the other.

    A null array gives null; an id without a token has the unknown token.
    """

    @F.pandas_udf("array<struct<token:string,id:int,begin:int,stop:int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def of(found: object) -> list[dict] | None:
            if found is None:
                return None
            out, before = [], 0
            for w in found:  # type: ignore[attr-defined]
                out += [{"token": model.names.get(i, model.unk), "id": i, "begin": before + a, "stop": before + b} for i, a, b in model.spans(w)]
                before += len(w)
            return out

        for series in batches:
            yield pd.Series([of(x) for x in series], dtype=object)

    return spans(words)


def merged_ids(words: Column, encode: Callable[[str], list[int]]) -> Column:
    """Ids of an array of words, in order, null if one is negative; each task encodes a word once while it remembers it."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory: dict[str, list[int]] = {}

        def of(found: object) -> list[int] | None:
            if found is None:
                return None
            if len(memory) > REMEMBERED:
                memory.clear()
            out: list[int] = []
            for w in found:  # type: ignore[attr-defined]
                if w not in memory:
                    memory[w] = encode(w)
                out += memory[w]
            return None if out and min(out) < 0 else out

        for series in batches:
            yield pd.Series([of(x) for x in series], dtype=object)

    return ids(words)


def tokenize(docs: DataFrame, bpe: Bpe, specials: dict[str, int] | None = None, text: str = "text", dropout: float = 0.0, seed: int = 0) -> DataFrame:
    """docs with ids: special tokens whole, everything else through pre-tokens, the byte alphabet and the merges.

    specials gives the ids of special tokens; without it they are looked up in the vocabulary.
    """
    whole = specials if specials is not None else {t: bpe.ids[t] for t in SPECIALS if t in bpe.ids}
    # NUL, which the byte alphabet lacks, marks special tokens on their way to the merges.
    shared = docs.sparkSession.sparkContext.broadcast((bpe, {f"\x00{t}": i for t, i in whole.items()}))

    def encode(word: str) -> list[int]:
        b, marked = shared.value
        if word in marked:
            return [marked[word]]
        if b.unk is None and len(b.symbols(word)) < len(word):
            return [-1]
        return b.merge(word, dropout, seed)

    def parts(run: Column) -> Column:
        pieces = F.transform(pre_tokens(run), byte_encode)
        return F.when(run.isin(*whole), F.array(F.concat(F.lit("\x00"), run))).otherwise(pieces) if whole else pieces

    runs = special_split(F.col(text), tuple(whole)) if whole else F.array(text)
    return docs.withColumn("ids", merged_ids(F.flatten(F.transform(runs, parts)), encode))
