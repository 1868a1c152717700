"""Metadata of PDF files: the document information that a file's trailer names, without an outside program."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import clean_title, last_name_first, lookup_query, stem

KEYS = ("title", "author", "subject")
_INFO = re.compile(rb"/Info\s+(\d+)\s+(\d+)\s+R")
_ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _string(raw: bytes, at: int) -> bytes:
    """The bytes of the string that starts at a place: in balanced parentheses or in hex digits; b'' if it is neither."""
    if raw[at : at + 1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw[at + 1 : raw.find(b">", at)])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    out, depth, i = bytearray(), 0, at
    while i < len(raw):
        c = raw[i : i + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(raw, i + 1)
            following = raw[i + 1 : i + 2].decode("latin-1")
            if octal:
                out.append(int(octal[0], 8) & 255)
                i = octal.end()
                continue
            if following not in "\r\n":
                out += _ESCAPED.get(following, following).encode("latin-1")
            i += 2
            continue
        if c == b"(":
            depth += 1
        elif c == b")":
            depth -= 1
            if not depth:
                return bytes(out)
        if depth and not (c == b"(" and depth == 1):
            out += c
        elif not depth:
            return b""
        i += 1
    return b""


def information(content: bytes | None) -> dict[str, str]:
    """title, author and subject as a file states them; '' for what it lacks, and for files whose information is in a compressed object."""
    found = {k: "" for k in KEYS}
    named = _INFO.findall(content or b"")
    if not named:
        return found
    bodies = re.findall(rb"(?<!\d)%s\s+%s\s+obj(.*?)endobj" % named[-1], content, re.DOTALL)
    for key in KEYS if bodies else ():
        place = re.search(rb"/%s\s*(?=[(<])" % key.title().encode(), bodies[-1])
        raw = _string(bodies[-1], place.end()) if place else b""
        wide, marked = raw.startswith(b"\xfe\xff"), raw.startswith(b"\xef\xbb\xbf")
        found[key] = raw[2:].decode("utf-16-be", "replace") if wide else raw[3:].decode("utf-8", "replace") if marked else raw.decode("latin-1")
    return found


@F.pandas_udf(T.StructType([T.StructField(k, T.StringType()) for k in KEYS]))
def _read(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([information(c) for c in contents], columns=list(KEYS))


def metadata(files: DataFrame) -> DataFrame:
    """path, raw_title, raw_author, subject, title (without what office programs add), author (last name first) and query (what to look the document up by); `files` has path and content."""
    rows = files.select("path", _read("content").alias("m"))
    title, subject = clean_title(F.col("m.title")), F.trim("m.subject")
    return rows.select("path", F.col("m.title").alias("raw_title"), F.col("m.author").alias("raw_author"), subject.alias("subject"), title.alias("title"), last_name_first(F.col("m.author")).alias("author"), lookup_query(title, subject, stem(F.col("path"))).alias("query"))


def read_metadata(spark: SparkSession, directory: str, pattern: str = "*.pdf") -> DataFrame:
    """metadata() of the files of a folder and its subfolders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
    return metadata(files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content"))
