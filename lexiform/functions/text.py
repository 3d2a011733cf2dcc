"""Unicode scalar functions as Column builders (NFC and NFD as Arrow UDFs, as Spark has no builtin, for the texts that need them)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes of the tokenizer, as regular-expression class bodies.
BLANK = r"\t\p{Zs}"
WORD_BLANK = r" \t\n\r\p{Zs}"
CONTROL = r"\p{C}"
WORD_CONTROL = r"\p{C}&&[^\t\n\r]"
PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"


#: Signs and letters beyond ASCII, all assigned, without blanks, controls and ideographs.
PLAIN = r"\x{00A1}-\x{00AC}\x{00AE}-\x{0377}"
#: Characters that are composed already and compose with none before or behind them in a text of them: without U+0130, whose lower case has a mark.
SIMPLE = r"\x{0000}-\x{012F}\x{0131}-\x{02FF}\x{0400}-\x{0482}\x{200B}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{4E00}-\x{9FFF}\x{FFFD}"
#: Characters whose normal form Python holds at a time, or a text if that has more.
TOGETHER = 1 << 20


def _normal(form: str):
    @F.arrow_udf(T.StringType())
    def normal(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts, held, size = [], [], 0
            for x in texts:
                if x := x.as_py():
                    size += len(x)
                    x = unicodedata.normalize(form, x)
                held.append(x)
                if size > TOGETHER:
                    parts.append(pa.array(held, pa.string()))
                    held, size = [], 0
            yield pa.concat_arrays([*parts, pa.array(held, pa.string())])

    return normal


_nfc, _nfd = _normal("NFC"), _normal("NFD")


def nfc(c: Column) -> Column:
    return _nfc(c)


def nfd(c: Column) -> Column:
    return _nfd(c)


def is_simple(c: Column) -> Column:
    """Whether a text has SIMPLE characters only, so that it is its own NFC; null for null."""
    return ~c.rlike(rf"[\x{{0130}}-\x{{10FFFF}}&&[^{SIMPLE}]]")  # Latin letters are through with one comparison


def _bare() -> tuple[str, str]:
    """The SIMPLE characters with marks, and what is left of each."""
    marked, left = [], []
    for begin, end in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", SIMPLE):
        for x in map(chr, range(int(begin, 16), int(end, 16) + 1)):
            bare = "".join(y for y in unicodedata.normalize("NFD", x) if unicodedata.category(y) != "Mn")
            if bare != x:
                marked.append(x)
                left.append(bare)
    return "".join(marked), "".join(left)


_MARKED = _bare()


def strip_simple(c: Column) -> Column:
    """strip_accents() of a simple text."""
    return F.when(c.rlike(r"[^\x{0000}-\x{007F}]"), F.translate(c, *_MARKED)).otherwise(c)


def strip_accents(c: Column) -> Column:
    """NFD, combining marks dropped, NFC; only texts with other than SIMPLE characters go to Python."""
    simple = is_simple(c)
    return F.when(simple, strip_simple(c)).otherwise(_nfc(F.regexp_replace(_nfd(F.when(~simple, c)), r"\p{Mn}", "")))


def is_whitespace(c: Column) -> Column:
    return c.rlike(f"[{BLANK}]")


def is_control(c: Column) -> Column:
    return c.rlike(f"[{CONTROL}]")


def is_punct(c: Column) -> Column:
    return c.rlike(f"[{PUNCTUATION}]")


def is_category(c: Column, name: str) -> Column:
    """Whether a one-character string has a two-letter general category."""
    return c.rlike(rf"^\p{{{name}}}$")


def category(c: Column) -> Column:
    """The two-letter general category of a one-character string; Cn if it has none."""
    names = "Lu Ll Lt Lm Lo Mn Me Mc Nd Nl No Zs Zl Zp Cc Cf Co Cs Pd Ps Pe Pc Po Sm Sc Sk So Pi Pf".split()
    out = F.lit("Cn")
    for n in reversed(names):
        out = F.when(is_category(c, n), n).otherwise(out)
    return out


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANK}]+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"[{BLANK}]+\\z", "")


def char_at(c: Column, i: int) -> Column:
    """The character at a 0-based place, U+FFFD beyond the end."""
    return F.coalesce(F.nullif(F.substring(c, i + 1, 1), F.lit("")), F.lit("�"))


def slice_chars(c: Column, begin: int, length: int = -1) -> Column:
    return F.substring(c, begin + 1, length if length >= 0 else 2**31 - 1)


def regex_split(c: Column, pattern: str) -> Column:
    """Gaps and matches of a pattern, in order; empty pieces are left out. Patterns don't match the empty string."""
    return F.filter(F.regexp_extract_all(c, F.lit(f"(?s){pattern}|((?:(?!{pattern}).)+)"), F.lit(0)), lambda x: x != "")


def clean_text(c: Column, cjk: bool = True) -> Column:
    """Drops NUL, U+FFFD and control characters, makes blanks spaces, sets CJK ideographs apart."""
    # A text of Latin letters and signs, most often, has nothing but tabs and line ends to change.
    plain = ~c.rlike(rf"[\x{{0000}}-\x{{001F}}\x{{007F}}-\x{{10FFFF}}&&[^\t\n\r{PLAIN}]]")
    ends = c
    for end in "\t\n\r":
        ends = F.replace(ends, F.lit(end), F.lit(" "))
    c = F.regexp_replace(c, r"[\x{0000}\x{FFFD}]", "")
    c = F.regexp_replace(c, rf"[\x{{0000}}-\x{{001F}}\x{{007F}}-\x{{10FFFF}}&&[{WORD_CONTROL}]]", "")
    c = F.regexp_replace(c, rf"[{WORD_BLANK}&&[^ ]]", " ")
    return F.when(plain, ends).otherwise(set_apart(c) if cjk else c)


def set_apart(c: Column) -> Column:
    """CJK ideographs between spaces."""
    return F.regexp_replace(c, rf"([\x{{3400}}-\x{{10FFFF}}&&[{CJK}]])", " $1 ")


def split_spaces(c: Column) -> Column:
    return F.array_remove(F.split(c, " "), "")


def split_punctuation(c: Column) -> Column:
    """A word cut at every punctuation character, each a word of its own."""
    return F.regexp_extract_all(c, F.lit(f"[{PUNCTUATION}]|[^{PUNCTUATION}]+"), F.lit(0))


def to_upper(c: Column) -> Column:
    return F.upper(c)


def starts_with(c: Column, prefix: Column) -> Column:
    return F.startswith(c, prefix)


def ends_with(c: Column, suffix: Column) -> Column:
    return F.endswith(c, suffix)


def concat(*cs: Column) -> Column:
    return F.concat(*cs)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by UTF-16 code units, in which characters above U+FFFF come before U+E000."""
    x, y = F.encode(a, "UTF-16BE"), F.encode(b, "UTF-16BE")
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def equal(a: Column, b: Column) -> Column:
    return compare(a, b) == 0


def hash_of(c: Column) -> Column:
    return F.xxhash64(c)


def units(c: Column) -> Column:
    """UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def from_utf8(raw: Column) -> Column:
    """The text of UTF-8 bytes, empty if they are none."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).when(raw.isNotNull(), F.lit(""))


def from_utf16(raw: Column) -> Column:
    return F.decode(raw, "UTF-16BE")


def from_utf32(points: Column) -> Column:
    """The text of an array of code points."""
    return F.decode(F.unhex(F.array_join(F.transform(points, lambda x: F.lpad(F.hex(x), 8, "0")), "")), "UTF-32")


def each(c: Column) -> Column:
    """The characters of a text, one for each code point."""
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def regex_test(c: Column, pattern: str) -> Column:
    """Whether a pattern is found anywhere."""
    return c.rlike(pattern)
