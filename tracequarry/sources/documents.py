"""Text of PDF files: the poppler program where it is installed, else the pypdf package, else what the files' own streams show."""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: A stream's data, and in it: a string, an array of strings, or an operator that moves to a new line.
STREAM = re.compile(rb"stream\r?\n(.*?)endstream", re.S)
SHOWN = re.compile(rb"(?P<text>\((?:\\.|[^\\()])*\))|(?P<line>T\*|(?<![A-Za-z])(?:Td|TD|ET|'|\")(?![A-Za-z]))|(?P<done>(?<![A-Za-z])T[jJ](?![A-Za-z]))|(?<![A-Za-z])BT(?![A-Za-z])", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def plain(literal: bytes) -> str:
    """A string's text: escapes by letter or octal number; an escaped line end is none."""

    def one(m: re.Match) -> bytes:
        told = m[1]
        if told.isdigit():
            return bytes([int(told, 8) & 255]) if told[:1] < b"8" else told
        return b"" if told.endswith(b"\n") else LETTERS.get(told, told)

    return ESCAPE.sub(one, literal).decode("latin-1")


def by_program(data: bytes) -> str:
    program = shutil.which("pdftotext")
    if not program:
        return ""
    try:
        ran = subprocess.run([program, "-q", "-enc", "UTF-8", "-eol", "unix", "-", "-"], input=data, capture_output=True, timeout=120)
    except (OSError, subprocess.SubprocessError):
        return ""
    return ran.stdout.decode("utf-8", "replace") if ran.returncode == 0 else ""


def by_package(data: bytes) -> str:
    try:
        import pypdf
    except ImportError:
        return ""
    try:
        return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages)
    except Exception:  # a damaged file; the package raises errors of many kinds
        return ""


def by_streams(data: bytes) -> str:
    """Strings that wait when a show operator comes, after a line end where the operator moves on; other strings aren't shown."""
    out: list[str] = []
    for found in STREAM.finditer(data):
        body = found[1]
        try:
            body = zlib.decompressobj().decompress(body)
        except zlib.error:
            pass  # not compressed
        waiting: list[str] = []
        for m in SHOWN.finditer(body):
            if m["text"]:
                waiting.append(plain(m["text"][1:-1]))
                continue
            if m["line"]:
                out.append("\n")
            if m["done"] or m["line"] in (b"'", b'"'):
                out += waiting
            waiting = []
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


def pdf_text(data: bytes) -> str:
    """The first way's text that isn't blank; empty if none has any."""
    for way in (by_program, by_package, by_streams):
        if (text := way(data)).strip():
            return text
    return ""


def pdf_documents(spark: SparkSession, path: str) -> DataFrame:
    """source, text of all *.pdf files under path; files without text, damaged ones too, are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"source": f["path"], "text": [pdf_text(bytes(d)) for d in f["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "source string, text string").where("text <> ''")
