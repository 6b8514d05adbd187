"""Interleaved document sequences: HTML becomes an ordered array of text and media references, and a join by digest puts
each reference's payload beside it, with its position and caption.

A media object is stored as a binary PGM image: a header, then a row of 192 grey samples of 8 bits for every 192 bytes, so
the payload is kept byte by byte. Its name is the SHA-256 of the payload, and `media:<digest>` refers to it.

Defined results: null HTML gives an empty sequence; a null text is stored as an empty one; a reference without a stored
object keeps its place with null media columns; equal payloads have one name and equal media columns; null ids stay;
repeated rows are answered one by one; other columns are left behind; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_rows, columns, schema

UNIT = 192
PREFIX = "media:"
PART = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
_SKIPPED = frozenset(("script", "style", "template", "noscript"))
_BLOCKS = frozenset("address article aside blockquote body dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul br html head".split())
_MEDIA = frozenset(("img", "video", "audio", "source", "embed"))


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.skipped = 0
        self.figure: list[int] | None = None
        self.caption = False
        self.captions: list[tuple[int, str]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if not text:
            return
        if self.caption and self.figure is not None:
            self.captions.append((len(self.parts), text))
            return
        self.add("text", text=text)

    def close_figure(self) -> None:
        """Gives a figure's caption to all its media parts; without any it is a text part where it stands."""
        if self.figure and self.captions:
            for i in self.figure:
                self.parts[i]["caption"] = " ".join(text for _, text in self.captions)
        elif self.captions:
            for at, text in reversed(self.captions):
                self.parts.insert(at, {"position": at, "kind": "text", "text": text, "ref": None, "caption": None})
            for i in range(self.captions[0][0], len(self.parts)):
                self.parts[i]["position"] = i
        self.figure, self.captions = None, []

    def add(self, kind: str, **values: str | None) -> None:
        self.parts.append({"position": len(self.parts), "kind": kind, "text": None, "ref": None, "caption": None} | values)

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skipped += 1
        if tag in _BLOCKS or tag in _MEDIA:
            self.flush()
        if tag == "figure":
            self.close_figure()
            self.figure = []
        if tag == "figcaption":
            self.caption = True
        if tag in _MEDIA and not self.skipped:
            given = dict(attrs)
            if given.get("src"):
                self.add("media", ref=given["src"], caption=(given.get("alt") or "").strip() or None)
                if self.figure is not None:
                    self.figure.append(len(self.parts) - 1)

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self.flush()
        if tag in _SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        if tag == "figcaption":
            self.caption = False
        if tag == "figure":
            self.close_figure()

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)


def sequence(html: str | None) -> list[dict]:
    """The parts of a page in order. A figure's caption goes to each media part of the figure, before it or behind; without any
    it is a text part. The texts of a caption's blocks are joined by spaces."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    parser.close_figure()
    return parser.parts


def parse(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", size_col: str | None = None) -> DataFrame:
    """A row for each page: its id, `size_col` (a long that is carried along) and `parts`, the ordered text and media parts."""
    batch_rows(pages.sparkSession)
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def work(batches):
        for batch in batches:
            found = pa.array([sequence(h) for h in batch.column(batch.num_columns - 1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*kept, "parts"])

    kept = [id_col, *[size_col] * bool(size_col)]
    picked = columns(pages, **dict.fromkeys(kept, "long"), **{html_col: "string"})
    return picked.mapInArrow(work, schema(", ".join(f"{c} long" for c in kept) + f", parts array<{PART}>"))


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def stored(data: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (UNIT, len(data) // UNIT) + data


def samples(form: bytes) -> bytes:
    """The payload of a stored object, checked against its header."""
    magic, shape, depth, data = form.split(b"\n", 3)
    width, height = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or len(data) != width * height:
        raise ValueError("not a stored media object")
    return data


def feature(data: bytes) -> str:
    """Mean, deviation and an 8 x 8 average hash of the image."""
    image = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
    rows = np.linspace(0, len(image), 9).astype(int)
    tiles = np.array([[image[min(a, len(image) - 1) : max(b, a + 1), c : c + UNIT // 8].mean() for c in range(0, UNIT, UNIT // 8)] for a, b in zip(rows, rows[1:])])
    bits = "".join("1" if x else "0" for x in (tiles > tiles.mean()).ravel())
    return f"{image.mean():.6f}:{image.std():.6f}:{int(bits, 2):016x}"


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a stored object: id, `n_bytes`, `digest`, `form`, and `html`, a page that shows the object."""
    batch_rows(df.sparkSession, 500)

    def work(batches):
        for batch in batches:
            sizes, digests, forms, pages = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = payload(text)
                sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                digests.append(hashlib.sha256(data).hexdigest())
                forms.append(stored(data))
                pages.append(f'<article><figure><img src="{PREFIX}{digests[-1]}"><figcaption>{sizes[-1]} bytes of text</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(forms, pa.binary()), pa.array(pages, pa.string())], [id_col, "n_bytes", "digest", "form", "html"])

    picked = columns(df, **{id_col: "long", text_col: "string"})
    return picked.mapInArrow(work, schema(f"{id_col} long, n_bytes long, digest string, form binary, html string"))


MEDIA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame, digest_col: str = "digest", form_col: str = "form") -> DataFrame:
    """What the stored bytes of each object say, one row for each digest. Payloads aren't shuffled."""
    batch_rows(media.sparkSession, 500)

    def work(batches):
        for batch in batches:
            out = []
            for form in batch.column(1).to_pylist():
                data = samples(form)
                out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(form), hashlib.sha256(form).hexdigest(), feature(data)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            named = [batch.column(0), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(named, [digest_col, *(c.split()[0] for c in MEDIA.split(", "))])

    found = columns(media, **{digest_col: "string", form_col: "binary"}).where(F.col(form_col).isNotNull())
    found = found.mapInArrow(work, schema(f"{digest_col} string, {MEDIA}"))
    return found.groupBy(digest_col).agg(*[F.first(c).alias(c) for c in found.columns if c != digest_col])


def resolve(parsed: DataFrame, described: DataFrame, digest_col: str = "digest") -> DataFrame:
    """A row for each part: what parse() kept, position, kind, text, caption, digest, and the media columns where the digest is stored."""
    kept = [c for c in parsed.columns if c != "parts"]
    parts = parsed.select(*kept, F.explode("parts").alias("p")).select(*kept, "p.position", "p.kind", "p.text", "p.caption", "p.ref")
    parts = parts.withColumn(digest_col, F.when(F.col("ref").startswith(PREFIX), F.substring("ref", len(PREFIX) + 1, 64)))
    return parts.join(described, digest_col, "left")
