"""Chunkers: a document becomes ordered chunks with headings and offsets.

Prose, Markdown, code and tables differ in what they prefer to cut at. A text is one span of offsets; a span that
is too long is cut at every place of its best separator, and spans between those places are packed by searching
the sorted places for the last one within the size, and back for the first one within the overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes in characters, separators in the order they are tried.
SIZE, OVERLAP, CODE_SIZE, CODE_OVERLAP = 1000, 150, 1200, 100
PROSE = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", ""]
TABLE = ["\n## ", "\n\n", "\n", " ", ""]
#: Words that begin a line at which code of a language may be cut, before blank lines, lines and spaces.
CODE_WORDS = {
    "python": ["class", "def", "\tdef"],
    "js": ["function", "const", "let", "var", "class", "if", "for", "while", "switch", "case", "default"],
    "ts": ["enum", "interface", "namespace", "type", "class", "function", "const", "let", "var", "if", "for", "while", "switch", "case", "default"],
    "go": ["func", "var", "const", "type", "if", "for", "switch", "case"],
    "rust": ["fn", "const", "let", "if", "while", "for", "loop", "match"],
    "java": ["class", "public", "protected", "private", "static", "if", "for", "while", "switch", "case"],
    "kotlin": ["class", "public", "protected", "private", "internal", "companion", "fun", "val", "var", "if", "for", "while", "when", "case", "else"],
    "c": ["class", "void", "int", "float", "double", "if", "for", "while", "switch", "case"],
    "ruby": ["def", "class", "if", "unless", "while", "for", "do", "begin", "rescue"],
    "php": ["function", "class", "if", "foreach", "while", "do", "switch", "case"],
    "swift": ["func", "class", "struct", "enum", "if", "for", "while", "do", "switch", "case"],
    "scala": ["class", "object", "def", "val", "var", "if", "for", "while", "match", "case"],
    "csharp": ["interface", "enum", "implements", "delegate", "event", "class", "abstract", "public", "protected", "private", "static", "return", "if", "continue", "for", "foreach", "while", "switch", "break", "case", "else", "try", "throw", "finally", "catch"],
    "lua": ["local", "function", "if", "for", "while", "repeat"],
    "haskell": ["main ::", "main =", "let", "in", "do", "where", "::", "=", "data", "newtype", "type", "module", "import", "qualified", "import qualified", "class", "instance", "case", "|", "= {", ","],
    "elixir": ["def", "defp", "defmodule", "defprotocol", "defmacro", "defmacrop", "if", "unless", "while", "case", "cond", "with", "for", "do"],
    "sol": ["pragma", "using", "contract", "interface", "library", "constructor", "type", "function", "event", "modifier", "error", "struct", "enum", "if", "for", "while", "do while", "assembly"],
}
#: Languages that are cut elsewhere than at words that begin a line.
CODE_PLACES = {
    "html": ["<body", "<div", "<p", "<br", "<li", "<h1", "<h2", "<h3", "<h4", "<h5", "<h6", "<span", "<table", "<tr", "<td", "<th", "<ul", "<ol", "<header", "<footer", "<nav", "<head", "<style", "<script", "<meta", "<title", ""],
    "latex": ["\n\\chapter{", "\n\\section{", "\n\\subsection{", "\n\\subsubsection{", "\n\\begin{enumerate}", "\n\\begin{itemize}", "\n\\begin{description}", "\n\\begin{list}", "\n\\begin{quote}", "\n\\begin{quotation}", "\n\\begin{verse}", "\n\\begin{verbatim}", "\n\\begin{align}", "$$", "$", " ", ""],
    "cobol": ["\nIDENTIFICATION DIVISION.", "\nENVIRONMENT DIVISION.", "\nDATA DIVISION.", "\nPROCEDURE DIVISION.", "\nWORKING-STORAGE SECTION.", "\nLINKAGE SECTION.", "\nFILE SECTION.", "\nINPUT-OUTPUT SECTION.", "\nOPEN ", "\nCLOSE ", "\nREAD ", "\nWRITE ", "\nIF ", "\nELSE ", "\nMOVE ", "\nPERFORM ", "\nUNTIL ", "\nVARYING ", "\nACCEPT ", "\nDISPLAY ", "\nSTOP RUN.", "\n", " ", ""],
}
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "js", "jsx": "js", "mjs": "js", "ts": "ts", "tsx": "ts", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "rb": "ruby", "php": "php", "swift": "swift", "scala": "scala",
    "cs": "csharp", "lua": "lua", "hs": "haskell", "ex": "elixir", "exs": "elixir", "html": "html", "htm": "html", "tex": "latex", "sol": "sol", "cob": "cobol", "cbl": "cobol",
}


def code_separators(extension: str) -> list[str]:
    language = LANGUAGES.get(extension.lower().lstrip("."), "")
    return CODE_PLACES.get(language) or [f"\n{w} " for w in CODE_WORDS.get(language, ())] + ["\n\n", "\n", " ", ""]


def _places(text: str, a: int, b: int, separator: str):
    """Offsets at which a span may be cut so that each part but the first begins with the separator; its ends included."""
    if not separator:
        return range(a, b + 1)
    places, at = [a], text.find(separator, a, b)
    while at >= 0:
        if at > a:
            places.append(at)
        at = text.find(separator, at + len(separator), b)
    places.append(b)
    return places


def _packed(places, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans from place to place within the size, each beginning at most the overlap before the end of the last."""
    i, last = 0, len(places) - 1
    while i < last:
        j = max(i + 1, bisect_right(places, places[i] + size) - 1)
        yield places[i], places[j]
        if j == last:
            return
        i = min(j, max(i + 1, bisect_left(places, places[j] - overlap), bisect_left(places, places[j + 1] - size)))


def split_spans(text: str, separators: list[str], size: int, overlap: int) -> list[tuple[int, int]]:
    """Offsets of the chunks of a text, in order, white space at their ends included.

    ``work`` holds spans still to be seen, the next one last: with the number of the first separator that may
    cut it, or -1 for a chunk that is done.
    """
    done, work = [], [(0, len(text), 0)]
    while work:
        a, b, level = work.pop()
        if level < 0 or level >= len(separators):
            done.append((a, b))
            continue
        at = next((i for i in range(level, len(separators)) if not separators[i] or text.find(separators[i], a, b) >= 0), len(separators) - 1)
        places = _places(text, a, b, separators[at])
        long = [] if isinstance(places, range) else [i for i in range(len(places) - 1) if places[i + 1] - places[i] >= size]
        found, start = [], 0
        for i in [*long, len(places) - 1]:
            found += [(x, y, -1) for x, y in _packed(places[start : i + 1], size, overlap)]
            if i < len(places) - 1:
                found.append((places[i], places[i + 1], at + 1))
            start = i + 1
        work += reversed(found)
    return done


def split(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    """Chunks of a text, stripped, in order: cut at the first separator it has, too long parts at the next ones."""
    return [c for c in (text[a:b].strip() for a, b in split_spans(text, separators, size, overlap)) if c]


def spans(body: Column, size: int, overlap: int = 0) -> Column:
    """Offsets of the pieces of a text as an array of (start, end): one for a text within the size, none for an empty one."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def cut(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield texts.map(lambda t: [{"start": a, "end": b} for a, b in split_spans(t, PROSE, size, overlap)])

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(body).alias("end")))
    long = F.length(body) > size
    return F.when(long, cut(F.when(long, body).otherwise(F.lit("")))).when(F.length(body) > 0, whole)


def markdown_sections(text: str) -> list[tuple[str, str]]:
    """(heading path, text) of each section, headings up to the third level, none inside code fences."""
    path: list[str] = ["", "", ""]
    out: list[tuple[str, list[str]]] = [("", [])]
    fence = ""
    for line in text.split("\n"):
        mark = line.lstrip()[:3]
        if mark in ("```", "~~~") and (not fence or mark == fence):
            fence = "" if fence else mark
        head = None if fence else re.match(r"(#{1,3})\s+(.*)", line)
        if head:
            level = len(head[1])
            path[level - 1 :] = [head[2].strip()] + [""] * (3 - level)
            out.append((" > ".join(p for p in path if p), []))
        else:
            out[-1][1].append(line)
    return [(h, t) for h, t in ((h, "\n".join(ls).strip()) for h, ls in out) if t]


def locate(content: str, chunks: list[str]) -> list[tuple[int | None, int | None]]:
    """Offsets of each chunk, searched forward from the last; by its first and last line where white space differs."""
    out, start = [], 0
    for chunk in chunks:
        at = content.find(chunk, start)
        if at < 0:
            at = content.find(chunk)
        if at >= 0:
            out.append((at, at + len(chunk)))
            start = at + 1
            continue
        lines = [x.strip() for x in chunk.split("\n") if x.strip()]
        first = content.find(lines[0], start) if lines else -1
        last = content.find(lines[-1], first) if first >= 0 else -1
        out.append((first, last + len(lines[-1])) if last >= 0 else (None, None))
        start = first + 1 if first >= 0 else start
    return out


def chunk(kind: str, content: str, extension: str = "", sizes: tuple[int, int] = (SIZE, OVERLAP), code_sizes: tuple[int, int] = (CODE_SIZE, CODE_OVERLAP), most: int | None = None) -> list[tuple[int, str, str, int | None, int | None, str]]:
    """(ord, text, heading, start, end, chunker) of a document's chunks.

    kind: prose, markdown, code, table or image. Of prose and code, ord is the place before too short chunks
    were dropped, so it may have gaps; of the others it is dense. All chunks come out unless ``most`` says how many.
    """
    if kind == "image":
        return [(0, content.strip(), "", 0, len(content), "image")] if content.strip() else []
    if kind == "markdown":
        parts = [(h, c) for h, section in markdown_sections(content) for c in split(section, PROSE, *sizes)]
        name = f"markdown:{sizes[0]}/{sizes[1]}"
    elif kind == "table":
        sections = [(m[1].strip() if (m := re.match(r"## (.*)", s.lstrip())) else "", s) for s in split(content, TABLE, sizes[0], 0)]
        parts, name = sections, f"table:{sizes[0]}"
    elif kind == "code":
        parts = [("", c) for c in split(content, code_separators(extension), *code_sizes)]
        name = f"code:{LANGUAGES.get(extension.lower().lstrip('.'), 'plain')}:{code_sizes[0]}/{code_sizes[1]}"
    else:
        parts, name = [("", c) for c in split(content, PROSE, *sizes)], f"prose:{sizes[0]}/{sizes[1]}"
    spans = locate(content, [c for _, c in parts])
    return [(i, c, h, a, b, name) for i, ((h, c), (a, b)) in enumerate(zip(parts, spans)) if most is None or i < most]


SCHEMA = "ord int, chunk string, heading string, char_start int, char_end int, chunker string, truncated boolean"


def chunk_documents(df: DataFrame, key: str, content: str, kind: Column, extension: Column, most: int | None = None) -> DataFrame:
    """Chunks of every document with text; key and ``SCHEMA``.

    With ``most``, a document's chunks after so many are left out, and ``truncated`` says so on those kept.
    """
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(content).alias("content"), kind.alias("kind"), F.coalesce(extension, F.lit("")).alias("extension")).where(F.length("content") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (text, k, e) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("content", "kind", "extension")))):
                got = chunk(k, text, e)
                over = most is not None and len(got) > most
                got = [(*c, over) for c in (got[:most] if over else got)]
                at += [i] * len(got)
                found += got
            columns = list(zip(*found)) or [()] * 7
            types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, types)], ["key", "ord", "chunk", "heading", "char_start", "char_end", "chunker", "truncated"])

    return rows.mapInArrow(run, f"key {key_type}, {SCHEMA}").withColumnRenamed("key", key)
