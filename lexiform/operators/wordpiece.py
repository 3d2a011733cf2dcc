"""WordPiece: words of a text, and their pieces by longest match.

Cleaning and splitting are Spark expressions; only the match is Python, an Arrow UDF over a text's words that remembers
what it cut, so no token is shuffled and a word of a third of all texts is no hot key. The vocabulary is read to the driver
behind a check of its size and shipped once to each executor. A word's remainder without a match becomes the unknown id
after the pieces matched so far; a special token that the vocabulary lacks is the unknown id.

That is the contract. ReferenceWalk keeps two defects of an older tokenizer instead, for results that must equal its:
letters between the longest piece and the end of the walk are lost, and a word after an unknown remainder may begin
with an inner piece. So a word's ids depend on the words before it, and each text is walked by itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiform.functions import text as T

# The tokens that stay whole, and the mark of a word's inner pieces.
SPECIALS = ("[CLS]", "[MASK]", "[PAD]", "[SEP]", "[UNK]")
INNER = "##"
#: Vocabulary rows that the driver takes; more is an error.
VOCAB_ROWS = 5_000_000
#: Words a task remembers the pieces of.
REMEMBERED = 100_000
#: Words whose ids a task looks up at a time.
TOGETHER = 1 << 18


@dataclass(frozen=True)
class Profile:
    """What is done to a text before its words are cut: a cased model by default."""

    clean: bool = True
    cjk: bool = True
    lower: bool = False
    accents: bool = True
    punctuation: bool = True

    @staticmethod
    def of(lower: bool = False, cjk: bool = True, strip_accents: bool | None = None, basic: bool = True) -> Profile:
        """From a model's settings; accents go with lower case unless told otherwise, and without basic splitting only blanks cut."""
        return Profile(basic, cjk, lower, not (lower if strip_accents is None else strip_accents), basic)


_DROPPED = regex.compile(rf"(?V1)[\x00\uFFFD]|[{T.WORD_CONTROL}]")
_BLANKS = regex.compile(f"[{T.WORD_BLANK}]")
_IDEOGRAPH = regex.compile("[" + regex.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), T.CJK) + "]")
_MARKS = regex.compile(r"\p{Mn}")
_PARTS = regex.compile(f"[{T.PUNCTUATION}]|[^{T.PUNCTUATION}]+")

CASED = Profile.of()
UNCASED = Profile.of(lower=True)


def basic_words(text: Column, profile: Profile = CASED, never_split: tuple[str, ...] = SPECIALS) -> Column:
    """Words of a text: composed, cleaned, split at blanks; unless protected as a whole, lower-cased, stripped, split at punctuation."""

    def cleaned(x: Column) -> Column:
        if profile.clean:
            return T.clean_text(x, profile.cjk)
        return T.set_apart(x) if profile.cjk else x

    def parts(raw: Column, word: Column) -> Column:
        cut = T.split_punctuation(word) if profile.punctuation else F.filter(F.array(word), lambda w: w != "")
        return F.when(raw.isin(*never_split), F.array(raw)).otherwise(cut) if never_split else cut

    def cut(x: Column, plain: Column) -> Column:
        # Lower case and stripping make and lose no spaces, so the words of both lie side by side.
        return F.flatten(F.zip_with(F.split(x, " "), F.split(plain, " "), parts))

    def simple(x: Column) -> Column:
        """The words of a simple text; as lambdas' variables each step is computed once, and nothing goes to Python."""
        if not profile.lower and profile.accents:
            return F.flatten(F.transform(F.split(cleaned(x), " "), lambda w: parts(w, w)))
        plain = (lambda t: F.lower(t)) if profile.lower else (lambda t: t)
        bare = plain if profile.accents else (lambda t: T.strip_simple(plain(t)))
        return F.element_at(F.transform(F.array(cleaned(x)), lambda t: cut(t, bare(t))), 1)

    # Lower case of a simple text is simple but for one letter, which is_simple() leaves out.
    easy = T.is_simple(text)
    odd = cleaned(T.nfc(F.when(~easy, text)))
    plain = F.lower(odd) if profile.lower else odd
    plain = plain if profile.accents else T.strip_accents(plain)
    return F.when(easy, simple(text)).otherwise(cut(odd, plain))


def split_text(text: str, profile: Profile = CASED, never_split: tuple[str, ...] = SPECIALS) -> list[str]:
    """basic_words() of one text in Python, for functions that SQL calls; both must agree."""
    text = unicodedata.normalize("NFC", text)
    if profile.clean:
        text = _BLANKS.sub(" ", _DROPPED.sub("", text))
    if profile.cjk:
        text = _IDEOGRAPH.sub(r" \g<0> ", text)
    out: list[str] = []
    for raw in text.split(" "):
        if raw in never_split:
            out.append(raw)
            continue
        word = raw.lower() if profile.lower else raw
        if not profile.accents:
            word = unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", word)))
        out += _PARTS.findall(word) if profile.punctuation else [word] if word else []
    return out


class Pieces:
    """A vocabulary that cuts words by longest match."""

    def __init__(self, ids: dict[str, int], unk_id: int, never_split: tuple[str, ...] = SPECIALS):
        self.all = ids
        self.whole = {t: ids.get(t, unk_id) for t in never_split}
        self.starts = {t: i for t, i in ids.items() if t not in self.whole}
        self.inner = {t.removeprefix(INNER): i for t, i in self.starts.items() if t.startswith(INNER)}
        self.unk_id = unk_id
        self.longest = max(map(len, self.starts), default=0)

    def ids(self, word: str) -> list[int]:
        if word in self.whole:
            return [self.whole[word]]
        out, at, known = [], 0, self.starts
        while at < len(word):
            for end in range(min(len(word), at + self.longest), at, -1):
                if (got := known.get(word[at:end])) is not None:
                    out.append(got)
                    at, known = end, self.inner
                    break
            else:
                return out + [self.unk_id]
        return out


def pieces(vocab: DataFrame, unk_id: int) -> Pieces:
    """The Pieces of (token, id)."""
    rows = vocab.select("token", "id").limit(VOCAB_ROWS + 1).collect()
    if len(rows) > VOCAB_ROWS:
        raise ValueError(f"a vocabulary of over {VOCAB_ROWS} rows")
    return Pieces({r["token"]: r["id"] for r in rows}, unk_id)


def chunks(found: pa.ListArray) -> Iterator[pa.ListArray]:
    """The rows of an array of arrays, in slices of TOGETHER words or so."""
    sizes = np.diff(found.offsets.to_numpy())
    marks = np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER)) + 1
    for at, to in zip([0, *marks.tolist()], [*marks.tolist(), len(found)]):
        yield found.slice(at, to - at)


def piece_ids(words: Column, cut: Pieces) -> Column:
    """Ids of an array of words, in order; a null array gives null. Python holds a chunk's distinct words only."""
    shared = SparkSession.active().sparkContext.broadcast(cut)

    def of_chunk(part: pa.ListArray, memory: dict[str, list[int]]) -> pa.ListArray:
        flat = part.flatten().dictionary_encode()
        # Rows' bounds among the words; a null row has none.
        bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))])
        ids = []
        for w in flat.dictionary.to_pylist():
            if w not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[w] = shared.value.ids(w)
            ids.append(memory[w])
        # Words follow each other as runs of ids; a run begins where its word's does in the distinct words' ids.
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        pool = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
        at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        places = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n)
        offsets = pa.array(ends[bounds].astype(np.int32), mask=np.append(part.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(pool[places], pa.int32()))

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory: dict[str, list[int]] = {}
        for found in batches:
            parts = [of_chunk(part, memory) for part in chunks(found)]
            yield pa.concat_arrays(parts)

    return ids(words)


def greedy_pieces(words: DataFrame, vocab: DataFrame, unk_id: int) -> DataFrame:
    """(word, ids) for the distinct words of (word), by longest match against (token, id)."""
    cut = pieces(vocab, unk_id)
    return words.select("word").distinct().select("word", piece_ids(F.array("word"), cut).alias("ids"))


class ReferenceWalk:
    """Ids of a text's words by one walk through a tree of all tokens' letters, with its defects."""

    def __init__(self, ids: dict[str, int], unk_id: int):
        self.start: dict = {}
        self.unk_id = unk_id
        for token, i in ids.items():
            node = self.start
            for letter in token:
                node = node.setdefault(letter, {})
            node[""] = i
        self.inner: dict = self.start
        for letter in INNER:
            self.inner = self.inner.get(letter, {})

    def ids(self, words: list[str]) -> list[int]:
        out, begin = [], self.start
        for word in words:
            at = 0
            while at < len(word):
                node, found = begin, None
                while at < len(word) and word[at] in node:
                    node = node[word[at]]
                    at += 1
                    found = node.get("", found)
                if found is None:
                    out.append(self.unk_id)
                    break
                out.append(found)
                begin = self.inner if at < len(word) else self.start
        return out


def reference_ids(words: Column, walk: ReferenceWalk) -> Column:
    """ReferenceWalk over arrays of words, in Arrow batches; a null array gives null."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in batches:
            parts = [pa.array([None if x is None else walk.ids(x) for x in part.to_pylist()], pa.list_(pa.int32())) for part in chunks(found)]
            yield pa.concat_arrays(parts)

    return ids(words)


def add_tokens(vocab: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, rejected): (token, id) with the new tokens (pos, token) behind it in order, and those it held already.

    Of a token that comes twice, the first is added. Ids go on from the largest; the window orders one vocabulary's rows.
    """
    last = vocab.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last")).first()["last"]
    nth = F.row_number().over(W.partitionBy("token").orderBy("pos"))
    asked = tokens.join(vocab.select("token", F.lit(True).alias("held")), "token", "left").withColumn("nth", nth)
    new = F.col("held").isNull() & (F.col("nth") == 1)
    added = asked.where(new).select("token", (F.row_number().over(W.orderBy("pos")) + last).cast("int").alias("id"))
    return vocab.select("token", F.col("id").cast("int").alias("id")).union(added), asked.where(~new).select("pos", "token")


def tokenize(docs: DataFrame, vocab: DataFrame, unk_id: int, key: str = "doc_id", compat: str = "contract", profile: Profile = CASED) -> DataFrame:
    """(key, pos, token_id) of all texts, special tokens whole; compat="reference" takes ReferenceWalk."""
    return token_ids(docs, vocab, unk_id, compat, profile).select(key, F.posexplode("ids").alias("pos", "token_id"))


def token_ids(docs: DataFrame, vocab: DataFrame, unk_id: int, compat: str = "contract", profile: Profile = CASED) -> DataFrame:
    """docs with ids beside its columns: a map without a shuffle."""
    if compat not in ("contract", "reference"):
        raise ValueError(f"unknown compat {compat}")
    cut = pieces(vocab, unk_id)
    words = basic_words(F.col("text"), profile)
    ids = piece_ids(words, cut) if compat == "contract" else reference_ids(words, ReferenceWalk(cut.all, unk_id))
    return docs.withColumn("ids", ids)


def look_up(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """tokens (token, and other columns) with the id of each, null where the vocabulary (token, id) lacks it."""
    return tokens.join(vocab.select("token", "id"), "token", "left")


def known(tokens: DataFrame, vocab: DataFrame, yes: bool = True) -> DataFrame:
    """The rows of tokens whose token the vocabulary holds, or, if not yes, lacks."""
    return tokens.join(vocab.select("token"), "token", "left_semi" if yes else "left_anti")


def only_here(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n): how often tokens (token, key) that no second document has occur in their own; a null key is no document.

    A token's rows are summed where they are read, so neither the rows nor a frequent token's go through a shuffle.
    """
    own = F.col(key).isNotNull()
    each = tokens.groupBy("token").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.when(own, 1)).alias("own"), F.count(F.when(~own, 1)).alias("loose"))
    kind = tokens.schema[key].dataType
    rows = F.array(F.struct(F.col("first").alias(key), F.col("own").alias("n")), F.struct(F.lit(None).cast(kind).alias(key), F.col("loose").alias("n")))
    return each.where("first <=> last").select(F.inline(rows)).where("n > 0")


def names(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """ids (id, and other columns) with the token of each, null where the vocabulary lacks it."""
    return ids.join(vocab.select("id", "token"), "id", "left")


def prefix_tokens(vocab: DataFrame, prefix: str) -> DataFrame:
    """The tokens below a prefix, which is at a node of the vocabulary's tree if there are any, and whether it is a token itself."""
    below = vocab.where(F.col("token").startswith(prefix))
    return below.select("token", "id", (F.col("token") == prefix).alias("here"), F.substring("token", len(prefix) + 1, 2**31 - 1).alias("rest"))
