"""Chapters from EPUB files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Elements whose texts stand on lines of their own.
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "section", "article", "body", "br", "tr", "table"}
LEAST_CHARS = 50


def _tag(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1].lower() if isinstance(node.tag, str) else ""


def crude_strip(html: str) -> str:
    """S08."""
    return re.sub(r"<[^>]+>", " ", html)


def xhtml_text(html: str) -> str:
    """The text, with block elements on lines of their own; without valid markup the tags are stripped."""
    try:
        root = ET.fromstring(html)
    except ET.ParseError:
        return re.sub(r"[ \t]+", " ", crude_strip(html)).strip()
    body = next((n for n in root.iter() if _tag(n) == "body"), root)
    lines: list[list[str]] = [[]]

    def walk(node: ET.Element) -> None:
        own = _tag(node) in BLOCKS
        if own:
            lines.append([])
        if node.text and node.text.strip():
            lines[-1].append(" ".join(node.text.split()))
        for child in node:
            walk(child)
            if child.tail and child.tail.strip():
                lines[-1].append(" ".join(child.tail.split()))
        if own:
            lines.append([])

    walk(body)
    return "\n".join(" ".join(line) for line in lines if line)


def xhtml_title(html: str, fallback: str) -> str:
    """The first title, h1 or h2 that is not blank."""
    for name in ("title", "h1", "h2"):
        m = re.search(rf"(?is)<{name}[^>]*>(.*?)</{name}>", html)
        if m and (text := " ".join(crude_strip(m[1]).split())):
            return text
    return fallback


def spine(book: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(name, markup) of the documents in reading order."""
    container = ET.fromstring(book.read("META-INF/container.xml"))
    opf = next(n.attrib["full-path"] for n in container.iter() if _tag(n) == "rootfile")
    package = ET.fromstring(book.read(opf))
    items = {n.attrib["id"]: n.attrib for n in package.iter() if _tag(n) == "item"}
    for ref in (n for n in package.iter() if _tag(n) == "itemref"):
        item = items.get(ref.attrib.get("idref", ""))
        if item and "html" in item.get("media-type", ""):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), item["href"]))
            if name in book.namelist():
                yield name, book.read(name).decode("utf-8", "replace")


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """chapter_number, title, content, source_path; documents of fewer than 50 characters are left out."""

    def chapters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source, content in zip(batch["path"], batch["content"], strict=True):
                for place, (name, html) in enumerate(spine(zipfile.ZipFile(io.BytesIO(content)))):
                    text = xhtml_text(html)
                    if len(text.strip()) >= LEAST_CHARS:
                        out.append((source, place, xhtml_title(html, posixpath.basename(name).rsplit(".", 1)[0]), text))
            yield pd.DataFrame(out, columns=["source_path", "place", "title", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path)
    found = files.select("path", "content").mapInPandas(chapters, "source_path string, place int, title string, content string")
    number = F.row_number().over(Window.partitionBy("source_path").orderBy("place"))
    return found.select(number.alias("chapter_number"), "title", "content", "source_path")
