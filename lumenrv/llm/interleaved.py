"""Interleaved document sequences: ordered text and media references from HTML, media resolved by digest.

Media lie in a store of their own, one row for each distinct payload under its SHA-256. Pages hold references only; parsing
gives one array of items in page order, a join on the digest attaches what is known of the media, and the array keeps its
order, so that an item's position and caption stay with it. Payloads themselves never go through a shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, materialize, shared_dir

ROW_BYTES = 192  # 64 pixels of three samples
PNG = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<pos: int, kind: string, text: string, src: string, digest: string, caption: string>"
MEDIA = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Elements that end a stretch of text, that hold none, and that refer to media.
BLOCKS = set("address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
SILENT = {"script", "style", "template", "title", "noscript"}
MEDIA_TAGS = {"img": "image", "video": "video", "audio": "audio"}


class _Sequence(HTMLParser):
    """Items of one page in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent = self.caption = 0
        self.figures: list[int] = []  # for each open figure its first item
        self.said: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "src": None, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        if tag in BLOCKS or tag in MEDIA_TAGS:
            self._flush()
        if tag == "figure":
            self.figures.append(len(self.items))
        elif tag == "figcaption" and self.figures:
            self.caption += 1
            self.said = []
        elif tag in MEDIA_TAGS or tag == "source" and self.items and self.items[-1]["kind"] != "text" and not self.items[-1]["src"]:
            held = dict(attrs)
            src = held.get("src") or None
            if tag == "source":
                item = self.items[-1]
            else:
                item = {"kind": MEDIA_TAGS[tag], "text": None, "caption": held.get("alt") or None}
                self.items.append(item)
            item["src"] = src
            item["digest"] = src[7:].lower() if src and src.lower().startswith("sha256:") else None

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SILENT or tag in ("figure", "figcaption"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption:
            self.caption -= 1
            caption = " ".join("".join(self.said).split())
            for item in self.items[self.figures[-1] :] if self.figures and caption else ():
                if item["kind"] != "text":
                    item["caption"] = caption
        elif tag in BLOCKS:
            self._flush()
        if tag == "figure" and self.figures:
            self.figures.pop()
            self.caption = 0

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.said if self.caption else self.text).append(data)


def parse_page(html: str | None) -> list[dict]:
    """Items of a page: text stretches and media references in order, positions from 0. Broken markup is read as it comes."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return [{"pos": i, **x} for i, x in enumerate(parser.items)]


def interleave(df: DataFrame, *, html_col: str = "html", items_col: str = "items") -> DataFrame:
    """df with the items of each page; a null or empty page has none."""

    @F.pandas_udf(f"array<{ITEM}>")
    def items(pages: pd.Series) -> pd.Series:
        return pages.map(parse_page)

    return df.withColumn(items_col, items(F.coalesce(F.col(html_col), F.lit(""))))


def resolve(df: DataFrame, media: DataFrame, *, items_col: str = "items") -> DataFrame:
    """df with a field media in each item: the other columns of media (unique by digest) as a struct, null if not found.

    References are joined by digest; a digest that very many pages share is split by the adaptive join, as the media side
    has one row for it. Order, positions and captions of the items are those of the page.
    """
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()))
    about = F.struct(*(c for c in media.columns if c != "digest"))
    refs = rows.select("__row", F.explode(items_col).alias("x")).select("__row", F.col("x.pos").alias("pos"), F.col("x.digest").alias("digest")).filter("digest is not null")
    found = refs.join(media.select("digest", about.alias("media")), "digest").groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "media"))).alias("__media"))
    out = rows.join(found, "__row", "left")
    return out.withColumn(items_col, F.transform(items_col, lambda x: x.withField("media", F.try_element_at("__media", x["pos"])))).drop("__row", "__media")


def padded(text: Column, unit: int = ROW_BYTES) -> Column:
    """The text with spaces up to a positive multiple of unit bytes."""
    over = F.pmod(F.octet_length(text), F.lit(unit))
    pad = F.when(F.octet_length(text) == 0, unit).otherwise(F.pmod(unit - over, F.lit(unit)))
    return F.concat(text, F.repeat(F.lit(" "), pad))


def to_png(payload: bytes) -> bytes:
    """Whole rows of 64 pixels with three 8-bit samples each as a PNG image; lossless."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    plain = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)  # each row begins with its filter, none
    plain[:, 1:] = rows
    out = [PNG]
    for kind, body in ((b"IHDR", struct.pack(">IIBBBBB", ROW_BYTES // 3, len(rows), 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(plain.tobytes(), 6)), (b"IEND", b"")):
        out.append(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)))
    return b"".join(out)


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png made."""
    if image[:8] != PNG:
        raise ValueError("not a PNG image")
    at, data, rows = 8, [], 0
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum does not fit")
        if kind == b"IHDR":
            rows = struct.unpack(">II", body[:8])[1]
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    plain = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, ROW_BYTES + 1)
    return plain[:, 1:].tobytes()


def store_media(payloads: DataFrame, folder: str) -> DataFrame:
    """Write payloads(digest, text) as images to a parquet folder; returns it as digest, media.

    A task writes a payload once; the same payload of other tasks is written again and is equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in byte_slices(batch, "text", 4 << 20):
                names, images = [], []
                for name, text in zip(part.column("digest").to_pylist(), part.column("text")):
                    if (key := bytes.fromhex(name)[:16]) not in seen:
                        seen.add(key)
                        names.append(name)
                        images.append(to_png(text.as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(images, pa.binary())], ["digest", "media"])

    schema = "digest string, media binary"
    payloads.select("digest", "text").mapInArrow(run, schema).write.option("compression", "none").parquet(folder)
    return payloads.sparkSession.read.schema(schema).parquet(folder)


def sample_features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a difference hash of the row means."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    level = np.arange(256)
    mean = float(share @ level)
    dev = float(np.sqrt(max(0.0, share @ (level * level) - mean * mean)))
    held = share[share > 0]
    entropy = float(-(held * np.log2(held)).sum())
    thumb = [p.mean() for p in np.array_split(x, 17)] if len(x) >= 17 else [0.0] * 17
    bits = sum((b > a) << i for i, (a, b) in enumerate(zip(thumb, thumb[1:])))
    return f"mean={mean:.4f};dev={dev:.4f};entropy={entropy:.4f};dhash={bits:04x}"


def media_facts(store: DataFrame) -> DataFrame:
    """MEDIA for each digest of the store, from the stored bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, image in zip(batch.column("digest").to_pylist(), batch.column("media")):
                raw = image.as_buffer().to_pybytes()
                payload = from_png(raw)
                rows.append((name, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), sample_features(payload)))
            names = [c.split()[0] for c in MEDIA.split(", ")]
            kinds = [pa.int64() if "long" in c else pa.string() for c in MEDIA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    facts = store.mapInArrow(run, MEDIA)
    rest = [c for c in facts.columns if c != "digest"]
    return facts.groupBy("digest").agg(*(F.max(c).alias(c) for c in rest))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document that shows its text as an image; the image's facts come back by way of the page."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), padded(text).alias("text"))
    docs = docs.withColumn("digest", F.sha2("text", 256))
    store = store_media(docs, shared_dir(spark))
    html = F.concat(F.lit("<article><h1>Document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit('</h1><figure><img alt="text" src="sha256:'), "digest", F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    pages = interleave(docs.select("doc_id", "n_bytes", html.alias("html")))
    facts = materialize(media_facts(store))  # one row for each payload; read anew, so that the join can split a common one
    shown = resolve(pages.drop("html"), facts)
    image = F.get(F.filter("items", lambda x: x["kind"] == "image"), F.lit(0))
    return shown.select("doc_id", "n_bytes", image.alias("image")).select("doc_id", "n_bytes", "image.media.*", F.col("image.pos").alias("pos"), F.col("image.caption").alias("caption"))
