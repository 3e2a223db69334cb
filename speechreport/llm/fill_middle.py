"""Fill-in-the-middle transformation, cutting whole texts between tokens with arithmetic on 64-bit words.

A token is a run of characters other than ASCII white space with the white space before it; white space at the
end is a token of its own. UTF-8 bytes are viewed as uint64. A few additions mark the white space among the eight
bytes of each word at once, hence the bytes that end a token, and bitwise_count counts the marks. Where
the k-th token ends is a binary search in the running sums of these counts for the word, and a select among
at most eight marks inside it. Code points before a cut are counted likewise. All documents of a portion
are searched together, so a task runs no loop over characters or tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks in front of the prefix, the suffix and the middle of a transformed text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 of these so many have the suffix first.
RATE, SPM = 50, 80
SEED = 42
#: Bytes of text that are searched together.
PORTION = 1 << 22


def _each(byte: int) -> np.uint64:
    return np.uint64(byte * 0x0101010101010101)


TOP, LOW7 = _each(0x80), _each(0x7F)
ONE, EIGHT, TOP_BYTE = np.uint64(1), np.uint64(8), np.uint64(56)


def blanks(x: np.ndarray) -> np.ndarray:
    """The top bit of each byte that is ASCII white space. No sum leaves its byte, as seven bits are added to at most 0x77."""
    low = x & LOW7
    space = ~((low ^ _each(0x20)) + LOW7)  # the top bit is left clear by zero alone
    control = (low + _each(0x80 - 0x09)) & ~(low + _each(0x80 - 0x0E))
    return (space | control) & ~x & TOP


def below(marks: np.ndarray, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marks lie in the bytes before byte ``at``; sums: running counts of the words, 0 first."""
    word, bit = at >> 3, ((at & 7) << 3).astype(np.uint64)
    return sums[word] + np.bitwise_count(marks[word] & ((ONE << bit) - ONE))


def select(marks: np.ndarray, sums: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The byte of the k-th mark, k from 1."""
    word = np.searchsorted(sums, k, "left") - 1
    left, rest = marks[word], k - sums[word]
    for _ in range(7):
        left = np.where(rest > 1, left & (left - ONE), left)
        rest = rest - 1
    bit = np.bitwise_count((left & (~left + ONE)) - ONE).astype(np.int64)
    return (word << 3) + (bit >> 3)


def _summed(marks: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(marks), dtype=np.int64)])


class Units:
    """The token ends of some texts, given as UTF-8."""

    def __init__(self, texts: list[bytes]):
        # at least one blank follows each text, so that its last character, unless blank, ends a token
        sizes = np.array([len(t) for t in texts], np.int64)
        spans = (sizes >> 3) + 1
        self.start = np.concatenate([np.zeros(1, np.int64), np.cumsum(spans)]) << 3
        x = np.frombuffer(b"".join(t.ljust(s << 3) for t, s in zip(texts, spans.tolist(), strict=True)), "<u8")
        blank = blanks(x)
        # a byte ends a token if it is no blank and the byte after it is one; the last byte of a text that ends with blanks also does
        after = (blank >> EIGHT) | np.concatenate([blank[1:] & np.uint64(0x80), np.zeros(1, np.uint64)]) << TOP_BYTE
        self.ends = after & ~blank & TOP
        last = (self.start[:-1] + sizes - 1)[sizes > 0]
        np.bitwise_or.at(self.ends, last >> 3, ONE << (((last & 7) << 3) + 7).astype(np.uint64))
        self.heads = ~(x & ~(x << ONE)) & TOP  # bytes that begin a code point
        self.end_sums, self.head_sums = _summed(self.ends), _summed(self.heads)
        bounds = self.end_sums[self.start >> 3]
        self.before, self.count = bounds[:-1], np.diff(bounds)

    def cuts(self, units: np.ndarray) -> np.ndarray:
        """Bytes of each text's first ``units`` tokens."""
        if not self.end_sums[-1]:
            return np.zeros(len(units), np.int64)
        found = select(self.ends, self.end_sums, np.maximum(self.before + units, 1))
        return np.where(units > 0, found + 1 - self.start[:-1], 0)

    def code_points(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code points in the bytes from begin to end of each text."""
        return below(self.heads, self.head_sums, self.start[:-1] + end) - below(self.heads, self.head_sums, self.start[:-1] + begin)


def portions(sizes: list[int]) -> Iterator[slice]:
    """Slices of texts of about PORTION bytes; a longer text is by itself."""
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > PORTION:
            yield slice(begin, i)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def seeded(key: Column, seed: int, group: int) -> Column:
    """Group number ``group`` (from 0) of eight hexadecimal digits of the SHA-256 of 'seed:key', as a number."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(told, 8 * group + 1, 8), 16, 10).cast("long")


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) for each row of df.

    n: tokens of the whole text. form: 'psm' (prefix, suffix, middle), 'spm' (suffix, prefix, middle) or 'plain', whose
    output is the text and whose numbers of code points are null. Null texts count as empty; empty ones and those
    that hold a mark are plain. Very long texts are cut like others. Choices depend on the key and the seed alone, so
    rows that share a key and a text are equal; rows without a key share the choices of the empty key. Bytes that
    aren't UTF-8 stay as they are. An empty table gives no rows; other columns are not read.
    """
    h = [seeded(F.col(key), seed, k) for k in range(4)]
    chosen = F.when(h[2] % 100 >= rate, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    asked = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"), h[0].alias("_h1"), h[1].alias("_h2"), chosen.alias("_form"))
    schema = asked.select("_key").withColumns({"n": F.lit(0).cast("long"), "form": F.lit(""), "prefix_chars": F.lit(None).cast("long"), "middle_chars": F.lit(None).cast("long"), "output": F.lit(b"")}).schema
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for batch in batches:
            for part in portions(pa.compute.binary_length(batch.column(1)).to_pylist()):
                rows = batch.slice(part.start, part.stop - part.start)
                texts, forms = rows.column(1).to_pylist(), rows.column(4).to_pylist()
                units = Units(texts)
                at = [rows.column(i).to_numpy() % (units.count + 1) for i in (2, 3)]
                low, high = units.cuts(np.minimum(*at)), units.cuts(np.maximum(*at))
                forms = ["plain" if not t or any(x in t for x in marks) else f for t, f in zip(texts, forms, strict=True)]
                out = []
                for t, f, a, b in zip(texts, forms, low.tolist(), high.tolist(), strict=True):
                    out.append(t if f == "plain" else p + t[:a] + s + t[b:] + m + t[a:b] if f == "psm" else s + t[b:] + p + t[:a] + m + t[a:b])
                plain = np.array([f == "plain" for f in forms], bool)
                before, middle = (pa.array(units.code_points(x, y), pa.int64(), mask=plain) for x, y in ((np.zeros_like(low), low), (low, high)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(units.count, pa.int64()), pa.array(forms, pa.string()), before, middle, pa.array(out, pa.binary())], schema.names)

    found = asked.mapInArrow(run, schema)
    return found.select(F.col("_key").alias(key), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from: transformed texts hold no marks but the three that were put in."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    get = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(get(1), get(3), get(2))).when(form == "spm", F.concat(get(2), get(3), get(1))).otherwise(output)
