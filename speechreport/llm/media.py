"""Interleaved document sequences: texts and media references in the order of an HTML page.

Media payloads are stored once for each digest as rows (digest, media) in a binary column; pages refer to them
by digest. Parsing a page gives ordered items, each a text or a reference with its caption; references
are resolved by a join on digests against what is read back from the stored media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechreport.llm.common import materialize, small

UNIT = 64
RATE = 16_000
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
BLOCKS = frozenset("p div article section header footer ul ol li table tr td th h1 h2 h3 h4 h5 h6 br pre blockquote figure figcaption nav title body".split())
SILENT = frozenset(("script", "style"))
MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "media"}


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of a text, null as empty, with bytes 0 up to a positive multiple of 64; and its own length."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0"), len(data)


def to_wav(payload: bytes) -> bytes:
    """The payload as 8-bit mono PCM samples in a WAV file (an odd last byte is padded, as RIFF asks)."""
    pad = len(payload) % 2
    return HEADER.pack(b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def from_wav(media: bytes) -> bytes:
    riff, _, wave, _, _, pcm, channels, _, _, _, bits, _, n = HEADER.unpack_from(media)
    if (riff, wave, pcm, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or len(media) < HEADER.size + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[HEADER.size : HEADER.size + n]


def feature(payload: bytes) -> str:
    """Samples, mean, root mean square about 128, peak, and a histogram over 8 equal ranges."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, level = max(1, len(payload)), np.arange(256)
    mean, power = (counts * level).sum() / n, (counts * (level - 128) ** 2).sum() / n
    peak = int(np.abs(np.flatnonzero(counts) - 128).max(initial=0))
    return f"n={len(payload)};mean={mean:.4f};rms={power**0.5:.4f};peak={peak};hist={','.join(map(str, counts.reshape(8, 32).sum(1)))}"


def described(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n, digest): the text's UTF-8 bytes, and the digest of its padded payload."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(data)
    payload = F.rpad(data, F.greatest(F.lit(1), F.ceil(n / UNIT)).cast("int") * UNIT, F.lit(b"\0"))
    return df.select(F.col(key), F.col(text).alias("text"), n.cast("long").alias("n"), F.sha2(payload, 256).alias("digest"))


def text_pages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, html): a page for each text, which refers to its medium by digest between two texts, with a caption."""
    figure = F.concat(F.lit('<figure><audio src="sha256:'), "digest", F.lit('" data-bytes="'), F.col("n").cast("string"), F.lit('"></audio><figcaption>'), F.col("n").cast("string"), F.lit(" bytes of text</figcaption></figure>"))
    return described(df, key, text).select(key, F.concat(F.lit("<article><p>reading</p>"), figure, F.lit("<p>end of the reading</p></article>")).alias("html"))


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, media): each distinct text once as a stored WAV file (rows that share a key as well are stored each)."""
    found = described(df, key, text)
    own = found.select(F.col(key).alias("_key"), F.unhex("digest").alias("_d"))
    firsts = own.groupBy("_d").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _first is not null")
    firsts = materialize(firsts.select("_d", "_first"))
    kept = found.withColumn("_d", F.unhex("digest")).join(small(firsts, 128), "_d", "left")
    kept = kept.filter(F.coalesce(F.col(key) == F.col("_first"), F.col("_first").isNull())).select("digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [to_wav(padded(x.as_py())[0]) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["digest", "media"])

    return kept.mapInArrow(run, "digest string, media binary")


def features(stored: DataFrame) -> DataFrame:
    """One row for each digest of the media read back, with the measures of its payload and stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                form = x.as_py()
                payload = from_wav(form)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), feature(payload)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    found = stored.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in names[1:]])


def squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class Figure:
    """An open figure: its media, its captions as (item that holds the place, parts), and whether the last is open."""

    def __init__(self) -> None:
        self.media: list[list] = []
        self.captions: list[tuple[list, list[str]]] = []
        self.open = False

    def settle(self) -> None:
        """Gives the captions to all media, and without media makes them text items."""
        caption = " ".join(filter(None, (squeezed(parts) for _, parts in self.captions)))
        for item in self.media:
            item[3] = caption or item[3]
        if not self.media:
            for item, parts in self.captions:
                item[1] = squeezed(parts) or None


class Sequence(HTMLParser):
    """Ordered items of one page: ("text", text, None, None, None) and (kind, None, ref, caption, bytes).

    A figure's caption is kept until the figure or the page ends. Text items without text only hold
    the place of a caption. Outside a figure a caption is text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.held: list[str] = []
        self.silent = 0
        self.figures: list[Figure] = []

    def flush(self) -> None:
        if text := squeezed(self.held):
            self.items.append(["text", text, None, None, None])
        self.held = []

    def captioning(self) -> bool:
        return bool(self.figures) and self.figures[-1].open

    def finish(self) -> list[list]:
        self.close()
        self.flush()
        while self.figures:
            self.figures.pop().settle()
        return [i for i in self.items if i[0] != "text" or i[1]]

    def block(self) -> None:
        self.flush()
        if self.captioning():
            self.figures[-1].captions[-1][1].append(" ")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        if tag in BLOCKS:
            self.block()
        if tag == "figure":
            self.figures.append(Figure())
        if tag == "figcaption" and self.figures:
            self.items.append(["text", None, None, None, None])
            self.figures[-1].captions.append((self.items[-1], []))
            self.figures[-1].open = True
        if tag in MEDIA:
            own = dict(attrs)
            if own.get("src"):
                self.flush()
                size = own.get("data-bytes") or ""
                self.items.append([MEDIA[tag], None, own["src"], own.get("alt") or None, int(size) if size.isdecimal() else None])
                if self.figures:
                    self.figures[-1].media.append(self.items[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.figures:
            self.figures[-1].open = False
        if tag in BLOCKS:
            self.block()
        if tag == "figure" and self.figures:
            self.figures.pop().settle()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.figures[-1].captions[-1][1] if self.captioning() else self.held).append(data)


def parse(html: str | None) -> list[list]:
    """Items of a page in order; null and empty pages have none."""
    page = Sequence()
    page.feed(html or "")
    return page.finish()


def sequences(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, items): an array of structs (kind, text, ref, caption, n_bytes) for each row, in page order."""
    kind = pa.struct([("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("kind", "text", "ref", "caption", "n_bytes")
        for batch in batches:
            items = [[dict(zip(fields, i, strict=True)) for i in parse(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(kind))], [key, "items"])

    schema = df.select(key).withColumn("items", F.lit(None).cast("array<struct<kind:string,text:string,ref:string,caption:string,n_bytes:bigint>>")).schema
    return df.select(key, html).mapInArrow(run, schema)


def resolve(found: DataFrame, stored: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each item of sequences(): key, position, kind, text, ref, caption, n_bytes and the
    features of the medium whose digest ref names (null for texts and for media that isn't stored).

    Null pages and pages without items give no rows. Rows that repeat a key give their items each.
    """
    items = found.select(key, F.posexplode("items").alias("position", "item")).select(key, "position", "item.*")
    items = items.withColumn("_digest", F.when(F.col("ref").startswith("sha256:"), F.substring("ref", 8, 64)))
    known = materialize(features(stored).withColumnRenamed("digest", "_digest"))
    return items.join(known, "_digest", "left").drop("_digest")


def store_and_resolve(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as media, parses the pages that refer to it and resolves the references.

    One row for each row of df: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, position, caption. Null and empty texts are 64 bytes 0, very long ones are stored
    whole. Equal texts share a stored medium, rows that repeat give a row each. Other columns are not read; an
    empty table gives no rows.
    """
    stored = materialize(store_texts(df, key, text))
    found = resolve(sequences(text_pages(df, key, text), key), stored, key).filter(F.col("kind") != "text")
    return found.select(key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
