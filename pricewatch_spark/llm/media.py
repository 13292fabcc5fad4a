"""Media columns: interleaved sequences of text and media references.

HTML is parsed into an ordered list of structs (pos, kind, text, digest, caption): running text,
and media with the digest its source names.  A media table holds every payload once a document in
a stored form that any image reader opens (binary PGM, one 8-bit grey sample a byte, rows of 64
samples, the unpadded length in the header's comment).  References are resolved by a join on the
digest; positions and captions stay with their reference.

Defined results: a null text or page is an empty one (its payload is 64 zero bytes); a reference
without stored payload keeps its place with null facts; equal payloads have one digest and equal
facts; repeated rows and null doc_ids are kept; very long texts are stored whole; references tie
in no order, each keeps its place; a caption of a figure without media, or of none, is text, and
one that is never closed ends with its figure or page; text inside noscript and template goes, but
stays if they are never closed; markup that doesn't follow the grammar is passed over; an empty table gives no rows; further
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as escape
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch_spark.llm.common import Scratch, raw_bytes, table, texts
from pricewatch_spark.sources.markup import TolerantParser

NAME = "op6_media"
ORACLE_SQL = None
ROW = 64
SCHEME = "media:sha256-"
ITEMS = "array<struct<pos: int, kind: string, text: string, digest: string, caption: string>>"
FACTS = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_MEDIA_TAGS = {"img", "audio", "video", "source", "embed"}
_SILENT = {"script", "style"}
#: Elements whose text goes when they are closed; without an end they are no elements.
_HIDDEN = {"noscript", "template"}
_BLOCKS = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "br", "section", "article", "figure", "table", "ul", "ol", "title", "nav", "header", "footer"}
_HEADER = re.compile(rb"P5\n# (\d+)\n64 (\d+)\n255\n")


class SequenceParser(TolerantParser):
    """Collects text runs and media references in reading order."""

    def __init__(self):
        super().__init__()
        self.items: list[dict] = []
        self.run: list[str] = []
        self.silent = 0
        self.hidden: list[tuple[str, int]] = []  # open elements of _HIDDEN, and where they begin
        self.figure: list[int] | None = None  # media of the open figure
        self.caption: list[str] | None = None  # text of the open caption
        self.captions: list[str] = []  # of the open figure

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self) -> None:
        """A caption waits for its figure's end; outside of a figure it is text."""
        if self.caption is not None:
            self.captions.append(" ".join("".join(self.caption).split()))
            self.caption = None
            if self.figure is None:
                self.end_figure()

    def end_figure(self) -> None:
        """The figure's captions, before or after its media, belong to all of them; without media they are text."""
        self.end_caption()
        text = " ".join(filter(None, self.captions))
        self.captions = []
        if text and self.figure:
            for k in self.figure:
                self.items[k]["caption"] = text
        elif text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.figure = None

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag in _HIDDEN:
            self.flush()
            self.hidden.append((tag, len(self.items)))
        elif tag in _MEDIA_TAGS:
            found = {k: v or "" for k, v in attrs}
            if source := found.get("src", ""):
                self.flush()
                digest = source.removeprefix(SCHEME) if source.startswith(SCHEME) else hashlib.sha256(source.encode("utf-8", "surrogatepass")).hexdigest()
                self.items.append({"kind": tag, "text": None, "digest": digest, "caption": found.get("alt") or found.get("title") or None})
                if self.figure is not None:
                    self.figure.append(len(self.items) - 1)
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.end_figure()
                self.figure = []
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in {x for x, _ in self.hidden}:
            self.flush()
            while self.hidden:
                name, start = self.hidden.pop()
                if name == tag:
                    break
            for item in self.items[start:]:
                if item["kind"] == "text":
                    item["text"] = None
        elif tag == "figcaption":
            self.end_caption()
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.end_figure()

    def handle_data(self, data):
        if not self.silent:
            (self.run if self.caption is None else self.caption).append(data)


def parse_sequence(page: str | None) -> list[dict]:
    parser = SequenceParser()
    parser.read(page or "")
    parser.flush()
    parser.end_figure()
    seen = (x for x in parser.items if x["kind"] != "text" or x["text"] is not None)
    return [{"pos": k, **item} for k, item in enumerate(seen)]


def interleaved(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, items: the ordered sequence of each page's html."""

    def run(batches):
        kind = pa.list_(pa.struct([("pos", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "digest", "caption"))]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([parse_sequence(x) for x in batch.column("html").to_pylist()], kind)], names=[key, "items"])

    return pages.select(key, F.col("html").cast("string").alias("html")).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, items {ITEMS}")


def encode(data: bytes) -> bytes:
    """The stored form of a payload: padded with zeros to a positive multiple of 64."""
    rows = max(1, -(-len(data) // ROW))
    return b"P5\n# %d\n64 %d\n255\n" % (len(data), rows) + data.ljust(rows * ROW, b"\0")


def decode(media: bytes) -> tuple[int, bytes]:
    """(unpadded length, samples) of a stored form."""
    head = _HEADER.match(media)
    size, rows = int(head[1]), int(head[2])
    samples = media[head.end() :]
    if len(samples) != rows * ROW:
        raise ValueError("the stored samples don't fill the rows that the header names")
    return size, samples


def feature(samples: bytes) -> str:
    """Sixteen-bin histogram, mean in thousandths and the sum of steps between samples."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    steps = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    return f"h={','.join(map(str, bins))};m={int(x.sum(dtype=np.int64)) * 1000 // len(x)};d={steps}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, html (a page that refers to the document's payload), digest, media (the stored form)."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            pages, digests, media = [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                stored = encode(raw_bytes(text).tobytes())
                digest = hashlib.sha256(stored).hexdigest()
                media.append(stored)
                digests.append(digest)
                name = escape.escape(str(i))
                pages.append(f'<article><p>Document {name}</p><figure><img src="{SCHEME}{digest}"><figcaption>Payload of {name}</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pages), pa.array(digests), pa.array(media, pa.binary())], names=["doc_id", "html", "digest", "media"])

    return texts(docs).mapInArrow(run, f"doc_id {id_type}, html string, digest string, media binary")


def facts(media: DataFrame) -> DataFrame:
    """What the stored bytes say, read back; one row a digest."""

    def run(batches):
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
                size, samples = decode(stored)
                rows.append((digest, size, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            names = [x.split()[0] for x in FACTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k in (0, 3, 6, 7) else pa.int64()) for k in range(len(names))], names=names)

    return media.select("digest", "media").mapInArrow(run, FACTS).dropDuplicates(["digest"])


def resolved(sequences: DataFrame, media_facts: DataFrame, key: str) -> DataFrame:
    """One row a media reference: key, pos, kind, caption, digest and the facts of its payload."""
    refs = sequences.select(key, F.explode("items").alias("i")).where("i.digest is not null").select(key, "i.pos", "i.kind", "i.caption", "i.digest")
    return refs.join(media_facts, "digest", "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "media")
    # the store: a written table, read back for pages and for payloads
    stored = scratch.write(store(table(spark, sf_dir, "documents")), "store")
    # its own table, so that Spark can split a payload that very many pages refer to in the join
    known = scratch.write(facts(stored), "facts")
    found = resolved(interleaved(stored, "doc_id"), known, "doc_id")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
