"""Text and metadata of PDF files without a library: flate-coded or plain content streams with simple fonts.

It reads what word processors and report writers put out as text; scanned pages have none and are marked.  Fonts with
their own encodings need a reader of their own, which `scan` takes as a parameter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_filename

SCAN_CHARS = 40  # a page with fewer characters is taken for a scan
INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")
SCHEMA = "path string, sha256 string, error string, metadata map<string,string>, pages array<struct<page_no:int,lines:array<string>,char_count:int,is_scan:boolean>>"
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


class PdfError(ValueError):
    pass


def _string(token: bytes) -> str:
    if token.startswith(b"<"):
        raw = bytes.fromhex((re.sub(rb"\s", b"", token[1:-1]) + b"0").decode()[: len(re.sub(rb"\s", b"", token[1:-1])) // 2 * 2])
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPE.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def _lines(content: bytes) -> list[str]:
    """Shown text by lines: a move down, a new line and a new text block each begin one."""
    lines, here, stack, items = [""], [], [], None
    for m in _TOKEN.finditer(content):
        t = m.group()
        if t == b"[":
            items = []
        elif t == b"]":
            stack.append(items or [])
            items = None
        elif t[:1] in b"(<":
            (items if items is not None else stack).append(_string(t))
        elif re.fullmatch(rb"[-+.\d]+", t):
            try:
                (items if items is not None else stack).append(float(t))
            except ValueError:
                pass
        else:
            op = t.decode("latin-1")
            if op in ("Td", "TD") and len(stack) >= 2 and stack[-1] != 0 or op in ("T*", "'", '"', "BT", "Tm"):
                lines.append("")
            if op in ("Tj", "'", '"') and stack and isinstance(stack[-1], str):
                lines[-1] += stack[-1]
            elif op == "TJ" and stack and isinstance(stack[-1], list):
                lines[-1] += "".join(x if isinstance(x, str) else " " if x < -200 else "" for x in stack[-1])
            stack = []
    return [x.rstrip() for x in lines if x.strip()] + here


def read(data: bytes) -> tuple[dict[str, str], list[list[str]]]:
    """Metadata and the lines of each page; an encrypted file, or none at all, is an error."""
    if not data.startswith(b"%PDF-"):
        raise PdfError("not a PDF")
    if re.search(rb"/Encrypt\b", data):
        raise PdfError("encrypted")
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}

    def stream(body: bytes) -> bytes:
        m = _STREAM.search(body)
        raw = m[1] if m else b""
        if b"/FlateDecode" in body[: m.start() if m else 0]:
            try:
                return zlib.decompressobj().decompress(raw)
            except zlib.error as e:
                raise PdfError(f"broken stream: {e}") from None
        return raw

    for body in list(objects.values()):  # objects packed in streams
        if b"/ObjStm" in body:
            count, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
            text = stream(body)
            numbers = list(map(int, text[:first].split()))[: 2 * count]
            at = numbers[1::2] + [len(text) - first]
            for n, a, b in zip(numbers[::2], at, at[1:]):
                objects.setdefault(n, text[first + a : first + b])

    def pages_of(number: int, seen: set[int]) -> Iterator[bytes]:
        body = objects.get(number, b"")
        if number in seen:
            return
        seen.add(number)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids:
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                yield from pages_of(int(k), seen)
        elif re.search(rb"/Type\s*/Page\b", body):
            yield body

    root = next((re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", b)[1] for b in objects.values() if re.search(rb"/Type\s*/Catalog", b) and re.search(rb"/Pages\s+(\d+)", b)), None)
    found = list(pages_of(int(root), set())) if root else [b for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]
    if not found:
        raise PdfError("no pages")
    pages = []
    for body in found:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        parts = [stream(objects.get(int(n), b"")) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []
        pages.append(_lines(b"\n".join(parts)))
    info = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", data)
    body = objects.get(int(info[1]), b"") if info else b""
    metadata = {k.lower(): _string(m[1]).strip() for k in INFO if (m := re.search(rb"/%s\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)" % k.encode(), body, re.S))}
    return {k.lower(): "" for k in INFO} | metadata | {"page_count": str(len(pages))}, pages


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, name (made safe), content of the files that match."""
    raw = spark.read.format("binaryFile").load(pattern)
    return raw.select("path", safe_filename(F.col("path")).alias("name"), "content")


def scan(found: DataFrame, reader: Callable[[bytes], tuple[dict[str, str], list[list[str]]]] = read, ocr: Callable[[bytes, int], list[str]] | None = None) -> DataFrame:
    """Pages and metadata of files (path, content), SCHEMA; a file that can't be read is a row with an error.

    A page with hardly a character is marked as a scan; `ocr` may give its lines, and one that fails leaves it as it is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                sha = hashlib.sha256(data or b"").hexdigest()
                try:
                    metadata, pages = reader(data or b"")
                    out = []
                    for n, lines in enumerate(pages, 1):
                        sparse = sum(map(len, lines)) < SCAN_CHARS
                        if sparse and ocr:
                            try:
                                lines = ocr(data, n)
                            except RuntimeError:
                                pass
                        out.append({"page_no": n, "lines": [x for x in lines if x.strip()], "char_count": sum(map(len, lines)), "is_scan": sparse})
                    rows.append((path, sha, None, metadata, out))
                except Exception as e:  # one bad file must not end the batch
                    rows.append((path, sha, f"{type(e).__name__}: {e}", None, None))
            yield pd.DataFrame(rows, columns=["path", "sha256", "error", "metadata", "pages"])

    return found.select("path", "content").mapInPandas(run, SCHEMA)
