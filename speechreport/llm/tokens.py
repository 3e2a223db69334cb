"""Token ids of whole texts, with the tokenizers library inside Arrow batch tasks.

The library's time goes to merges of words that it has already merged. Texts whose characters all lie
below U+0100 are cut where the tokenizer's own pre-tokenizer cuts them, and each distinct piece is
encoded once while a worker keeps it, by the library's model, since cutting and normalizing are done;
other texts, and those that hold the string of an added token, go through the library whole.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values below U+0100: letters, numbers and white space as Unicode classes them.
LETTERS, NUMBERS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
#: How the two vocabularies cut text (the class names stand for the ones above).
CUTS = {
    "byte": "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+",
    "word": "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+",
}
#: Pieces in each of the two generations that a worker keeps: about 100 MB each.
CACHED = 500_000
LONGEST_CACHED = 64


class Pieces(dict):
    """Little-endian ids of a piece of text; encodes a piece when it is first asked for.

    When the newer generation is full it becomes the older one, so pieces in use stay.
    """

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def byte_letters() -> str:
    """The letters that stand for the 256 bytes in byte-level vocabularies, for str.translate on Latin-1.

    Bytes that print stand for themselves, the rest for the letters from U+0100 on, in order.
    """
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in prints]
    return "".join(chr(b if b in prints else 256 + rest.index(b)) for b in range(256))


class Encoder:
    """encode(text) -> bytes of little-endian unsigned ids, 2 bytes each if the vocabulary allows."""

    def __init__(self, path: str, kind: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.dtype = "<u2" if library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.whole = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        code, letters, merge, swap = "H" if self.dtype == "<u2" else "I", byte_letters(), library.model.tokenize, sys.byteorder != "little"

        def piece(text: str) -> bytes:
            # of the ASCII characters that print only the space has another letter
            plain = text.isascii() and text.isprintable()
            told = text.replace(" ", letters[32]) if plain else text.encode().decode("latin-1").translate(letters)
            ids = array(code, [t.id for t in merge(told)])
            if swap:
                ids.byteswap()
            return ids.tobytes()

        self.pieces = Pieces(piece)
        wide = re.compile("[^\\x00-\\xff]").search
        self.wide = lambda text: not text.isascii() and wide(text)
        self.cut = re.compile(CUTS[kind].format(L=LETTERS, N=NUMBERS, S=BLANKS)).findall
        self.lower = kind == "word"
        self.added = [t.content.lower() if self.lower else t.content for t in library.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        told = text.lower() if self.lower else text
        if self.wide(text) or any(t in told for t in self.added):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, self.cut(told)))


#: One encoder for each vocabulary and worker.
_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def id_width(path: str) -> str:
    """The numpy type of the ids: the vocabulary's size decides."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def tokenize(df: DataFrame, path: str, kind: str, text: str = "text", end_id: int = 2) -> DataFrame:
    """df's columns with ``text`` replaced by n_tokens (long) and ids (binary), the end id last.

    Null texts count as empty and get the end id alone.
    """
    width, kept = id_width(path), [c for c in df.columns if c not in (text, "n_tokens", "ids")]
    end = np.array([end_id], width).tobytes()
    size = np.dtype(width).itemsize
    schema = df.select(*kept).withColumns({"n_tokens": F.lit(0).cast("long"), "ids": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, kind).encode
        for batch in batches:
            ids = [encode(x.as_py() or "") + end for x in batch.column(len(kept))]
            own = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(x) // size for x in ids], pa.int64()), pa.array(ids, pa.binary())], [*kept, "n_tokens", "ids"])

    return df.select(*kept, text).mapInArrow(run, schema)
