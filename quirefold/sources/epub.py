"""EPUB files as pages: one row for each place of the reading order."""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from dataclasses import dataclass
from html.entities import name2codepoint
from io import BytesIO
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SILENT = {"script", "style", "svg", "math"}
# The elements that stand on lines of their own.
_BLOCK = set("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead tr ul".split())
_NAMED = re.compile(rb"&([A-Za-z][A-Za-z0-9]*);")
_PAGES = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("text", pa.string()), ("reason", pa.string())])


@dataclass(frozen=True)
class Limits:
    entries: int = 4096
    entry_bytes: int = 16 << 20
    total_bytes: int = 128 << 20
    depth: int = 128
    pages: int = 1000


class Rejected(ValueError):
    """The file is not one that is read; the message is the reason."""


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _numbered(m: re.Match[bytes]) -> bytes:
    """A named entity of HTML by its number; XML's own five and unknown ones stay."""
    code = None if m[1] in (b"amp", b"lt", b"gt", b"quot", b"apos") else name2codepoint.get(m[1].decode())
    return m[0] if code is None else b"&#%d;" % code


def _parse(data: bytes) -> ET.Element:
    if re.search(rb"<!\s*(ENTITY)", data[:65536], re.I):
        raise Rejected("malformed_document")
    try:
        return ET.fromstring(_NAMED.sub(_numbered, data))
    except ET.ParseError as e:
        raise Rejected("malformed_document") from e


def xhtml_text(data: bytes, limits: Limits = Limits()) -> str:
    """Visible text: a line for each block, white space collapsed, empty lines dropped."""
    parts: list[str] = []

    def walk(node: ET.Element, depth: int) -> None:
        if depth > limits.depth:
            raise Rejected("malformed_document")
        name = _local(node.tag)
        if name in _SILENT or name in ("head", ""):
            return
        edge = "\n" if name in _BLOCK else ""
        parts.append(edge + (node.text or "").replace("\n", " "))
        for child in node:
            walk(child, depth + 1)
            parts.append((child.tail or "").replace("\n", " "))
        parts.append(edge)

    walk(_parse(data), 1)
    lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


def _open(data: bytes, limits: Limits) -> zipfile.ZipFile:
    try:
        book = zipfile.ZipFile(BytesIO(data))
    except (zipfile.BadZipFile, NotImplementedError, EOFError) as e:
        raise Rejected("malformed_document") from e
    infos = book.infolist()
    names = [i.filename for i in infos]
    if not infos or len(infos) > limits.entries or len(set(names)) != len(names):
        raise Rejected("malformed_document")
    if names[0] != "mimetype" or infos[0].compress_type != zipfile.ZIP_STORED or book.read(infos[0]) != b"application/epub+zip":
        raise Rejected("malformed_document")
    if any(n.startswith("/") or "\\" in n or "\0" in n or ".." in n.split("/") for n in names):
        raise Rejected("unsafe_path")
    if any(i.flag_bits & 1 for i in infos) or "META-INF/encryption.xml" in names:
        raise Rejected("encrypted_document")
    if any(i.file_size > limits.entry_bytes for i in infos) or sum(i.file_size for i in infos) > limits.total_bytes:
        raise Rejected("too_large")
    return book


def read_epub(data: bytes, limits: Limits = Limits()) -> list[tuple[int, str]]:
    """(page number, text) in reading order; places without text keep their number and are left out."""
    try:
        book = _open(data, limits)
        root = next(x.get("full-path") for x in _parse(book.read("META-INF/container.xml")).iter() if _local(x.tag) == "rootfile")
        package = _parse(book.read(root))
        items = {x.get("id"): (x.get("href"), x.get("media-type")) for x in package.iter() if _local(x.tag) == "item"}
        spine = [x.get("idref") for x in package.iter() if _local(x.tag) == "itemref"]
        if not spine or len(spine) > limits.pages:
            raise Rejected("malformed_document")
        out = []
        for number, key in enumerate(spine, 1):
            href, kind = items[key]
            if kind == "application/xhtml+xml":
                path = posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(href.split("#")[0])))
                if text := xhtml_text(book.read(path), limits):
                    out.append((number, text))
    except (KeyError, StopIteration, AttributeError, TypeError, EOFError, NotImplementedError, RuntimeError, zipfile.BadZipFile, zlib.error) as e:
        raise Rejected("malformed_document") from e
    if not out:
        raise Rejected("no_extractable_text")
    return out


def epub_pages(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """Pages of all EPUB files below ``path``; a file that is rejected is one row with its reason."""

    def run(batches):
        for batch in batches:
            rows = {n: [] for n in _PAGES.names}
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    found = [(n, t, None) for n, t in read_epub(data, limits)]
                except Rejected as e:
                    found = [(None, None, str(e))]
                for n, t, reason in found:
                    for c, v in zip(_PAGES.names, (name, n, t, reason)):
                        rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=_PAGES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, page_no int, text string, reason string")
