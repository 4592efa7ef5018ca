"""Markdown files as segments: found in a workspace, cut at headings, long ones split and short ones joined."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.functions import parsing

MOST, LEAST = 2000, 200
_front = re.compile(r"^﻿?---[ \t]*\n.*?\n---[ \t]*\n", re.S)
_heading = re.compile(r"^ {0,3}(#{1,3})\s+(.*?)\s*#*\s*$")
_fence = re.compile(r"^ {0,3}(`{3,}|~{3,})")

Part = tuple[str | None, int | None, str]


def sections(text: str) -> list[Part]:
    """(heading, level, content) of the stretches between headings of level 1 to 3 that stand outside of fences."""
    out: list[list] = [[None, None, []]]
    fence = None
    for line in text.split("\n"):
        if fence is not None:
            fence = None if line.lstrip().startswith(fence) else fence
        elif m := _fence.match(line):
            fence = m[1][:3]
        elif m := _heading.match(line):
            out.append([f"{m[1]} {m[2]}", len(m[1]), []])
            continue
        out[-1][2].append(line)
    found = [(h, n, "\n".join(body).strip()) for h, n, body in out]
    return found if len(found) == 1 or found[0][2] else found[1:]


def by_words(text: str) -> list[str]:
    """Pieces of MOST characters at most, cut at blanks where there are any."""
    out = []
    while len(text) > MOST:
        at = text.rfind(" ", 0, MOST + 1)
        at = at if at > 0 else MOST
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [*out, text] if text else out


def by_paragraphs(text: str) -> list[str]:
    """Pieces of MOST characters at most, of whole paragraphs where these are short enough."""
    paragraphs = [p for p in re.split(r"\n\s*\n", text) if p.strip()]
    if len(paragraphs) <= 1:
        return by_words(text) if len(text) > MOST else [text]
    out, now = [], ""
    for p in paragraphs:
        joined = f"{now}\n\n{p}" if now else p
        if len(p) > MOST:
            out += [now] * bool(now) + by_words(p)
            now = ""
        elif len(joined) > MOST and now:
            out.append(now)
            now = p
        else:
            now = joined
    return out + [now] * bool(now)


def segments(text: str) -> list[Part]:
    """(heading, level, content) of a file's segments; a split section's heading is its first piece's."""
    text = _front.sub("", text.replace("\r\n", "\n"), count=1)
    if not text.strip():
        return []
    parts: list[Part] = []
    for heading, level, content in sections(text):
        if not content and not heading:
            continue
        whole = f"{heading}\n\n{content}" if heading else content
        pieces = by_paragraphs(whole) if len(whole) > MOST else [whole]
        parts += [(heading, level, p) if i == 0 else (None, None, p) for i, p in enumerate(pieces)]
    out: list[Part] = []
    for heading, level, content in parts:
        if out and len(out[-1][2]) < LEAST:
            h, n, before = out[-1]
            out[-1] = (h if h is not None else heading, n if n is not None else level, f"{before}\n\n{content}")
        else:
            out.append((heading, level, content))
    return out


def segmented(files: DataFrame) -> DataFrame:
    """Segments (SEGMENT) of files (path, text); path is relative to the workspace. Null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, h, n, c, len(c)) for p, t in zip(b["path"], b["text"], strict=True) if t is not None for i, (h, n, c) in enumerate(segments(t))]
            out = pd.DataFrame(rows, columns=["path", "id", "heading", "heading_level", "content", "char_count"])
            out["heading_level"] = out["heading_level"].astype("Int32")
            yield out

    rows = files.select("path", "text").mapInPandas(run, "path string, id int, heading string, heading_level int, content string, char_count int")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("id", F.col("path").alias("source_file"), "heading", "heading_level", parsing.date_of_file(name).alias("date"), parsing.evergreen(F.col("path")).alias("evergreen"), F.lit(False).alias("session"), "content", "char_count")


def discovered(spark: SparkSession, workspace: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) of a workspace's memory files: MEMORY.md or memory.md, memory/**.md, and extra files and folders.

    Links aren't followed where the file system shows them; a path counts once; the root's files come first, then paths
    in order.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = workspace.rstrip("/")
    fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found: list[str] = []

    def walk(path) -> None:
        for s in sorted(fs.listStatus(path), key=lambda s: s.getPath().getName()):
            if s.isSymlink() or _is_link(s.getPath()):
                continue
            if s.isDirectory():
                walk(s.getPath())
            elif s.getPath().getName().endswith(".md"):
                found.append(s.getPath().toString())

    def _is_link(path) -> bool:
        import os

        return path.toUri().getScheme() in (None, "file") and os.path.islink(path.toUri().getPath())

    names = {s.getPath().getName() for s in fs.listStatus(hadoop.Path(root)) if s.isFile()} if fs.exists(hadoop.Path(root)) else set()
    found += [hadoop.Path(f"{root}/{n}").makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString() for n in ("MEMORY.md", "memory.md") if n in names]
    for place in ("memory", *extra):
        path = hadoop.Path(place if "/" in place and (place.startswith("/") or ":" in place) else f"{root}/{place}")
        if fs.exists(path):
            status = fs.getFileStatus(path)
            if status.isDirectory():
                walk(path)
            elif place != "memory" and path.getName().endswith(".md"):
                found.append(status.getPath().toString())
    found = list(dict.fromkeys(found))
    if not found:
        return spark.createDataFrame([], "path string, text string")
    base = hadoop.Path(root).makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString().rstrip("/") + "/"
    base = re.sub(r"^file:/+", "/", base)
    plain = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    rel = F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, 10_000)).otherwise(plain)
    rows = spark.read.option("wholetext", True).text(found).select(rel.alias("path"), F.col("value").alias("text"))
    at_root = F.lower(F.element_at(F.split("path", "/"), -1)) == "memory.md"
    return rows.orderBy(F.desc(at_root), "path")


SEGMENT = S.SEGMENT
