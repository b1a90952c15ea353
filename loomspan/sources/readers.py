"""Readers: bytes of files to text with title, metadata and author hints. More can be registered."""

from __future__ import annotations

import email
import email.policy
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from email.utils import formataddr, getaddresses, parseaddr

import pandas as pd
from pyspark.sql import DataFrame

__all__ = ["decode", "extract", "formataddr", "front_matter", "getaddresses", "parseaddr", "register"]

Reader = Callable[[str, bytes], dict]
_READERS: dict[str, Reader] = {}
SCHEMA = "path string, reader string, text string, title string, meta string, authors array<string>, bytes_sha string, text_sha string, problem string"
#: Words of tools that write themselves into author fields.
TOOL_NAMES = ("microsoft", "word", "adobe", "acrobat", "latex", "pandoc", "quartz", "ghostscript", "libreoffice", "unknown", "admin", "user")


def register(*extensions: str):
    """Adds a reader for extensions: a function of path and bytes that returns text, title, meta and authors."""

    def add(reader: Reader) -> Reader:
        for e in extensions:
            _READERS[e.lower().lstrip(".")] = reader
        return reader

    return add


def decode(data: bytes) -> str:
    """Text of bytes: by a byte order mark, else UTF-8, else Windows-1252, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                break
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def front_matter(text: str, most: int = 200) -> tuple[dict, str]:
    """Mapping between --- lines at the top (at most ``most`` lines) and the text after it; {} and all text where there is none.

    Of YAML it knows scalars, quoted strings, [inline] and dashed lists.
    """
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        return {}, text
    end = next((i for i, x in enumerate(lines[1 : most + 1], 1) if x.strip() in ("---", "...")), None)
    if end is None:
        return {}, text
    meta: dict = {}
    key = None
    for line in lines[1:end]:
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item = re.match(r"\s*-\s+(.*)", line)
        if item and key:
            if not isinstance(meta[key], list):
                meta[key] = []
            meta[key].append(_scalar(item[1]))
            continue
        pair = re.match(r"([\w .-]+):(?:\s+(.*))?$", line)
        if not pair:
            return {}, text
        key = pair[1].strip()
        meta[key] = _scalar(pair[2] or "")
    return (meta, "\n".join(lines[end + 1 :]).lstrip("\n")) if meta else ({}, text)


def _scalar(raw: str):
    raw = raw.strip()
    if raw[:1] in "\"'" and raw[-1:] == raw[:1] and len(raw) > 1:
        return raw[1:-1]
    if raw.startswith("[") and raw.endswith("]"):
        return [_scalar(x) for x in raw[1:-1].split(",") if x.strip()]
    return {"true": True, "false": False, "null": None, "~": None, "": ""}.get(raw.lower(), raw)


def author_hints(meta: dict) -> list[str]:
    """Names of people in metadata, without tools, at most five."""
    found: list[str] = []
    for key in ("author", "authors", "by", "creator", "from"):
        value = meta.get(key) or []
        for name in value if isinstance(value, list) else [value]:
            name = str(name).strip()
            if name and name not in found and not any(t in name.lower() for t in TOOL_NAMES):
                found.append(name)
    return found[:5]


def _title(text: str, path: str) -> str:
    lines = text.split("\n")
    for line in lines[:40]:
        if re.match(r"#\s+\S", line):
            return line[1:].strip()
    return next((x.strip() for x in lines[:10] if 3 <= len(x.strip()) <= 200), re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]))


@register("md", "markdown", "txt", "text", "log", "rst", "csv", "json", "yaml", "yml", "toml", "ini")
def read_text(path: str, data: bytes) -> dict:
    meta, body = front_matter(decode(data).replace("\r\n", "\n"))
    return {"reader": "text", "text": body, "title": str(meta.get("title") or _title(body, path)), "meta": meta, "authors": author_hints(meta)}


@register("py", "rs", "go", "js", "ts", "java", "c", "h", "cpp", "rb", "php", "swift", "sql", "sh")
def read_code(path: str, data: bytes) -> dict:
    return {"reader": "code", "text": decode(data).replace("\r\n", "\n"), "title": path.rsplit("/", 1)[-1], "meta": {}, "authors": []}


@register("eml")
def read_mail(path: str, data: bytes) -> dict:
    mail = email.message_from_bytes(data, policy=email.policy.default)
    body = mail.get_body(preferencelist=("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_subtype() == "html":
        text = re.sub(r"[ \t]+", " ", re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style).*?</\1>", " ", text)))
    people = [formataddr(a) for a in getaddresses([str(mail.get("from", ""))]) if a[1]]
    meta = {k: str(mail.get(k)) for k in ("subject", "from", "to", "date", "message-id") if mail.get(k)}
    return {"reader": "mail", "text": text.strip(), "title": meta.get("subject", _title(text, path)), "meta": meta, "authors": people}


def extract(files: DataFrame) -> DataFrame:
    """Text of files with ``path`` and ``content`` (binary), as ``spark.read.format("binaryFile")`` gives them.

    Files without a reader and files that fail come out with a ``problem`` and no text.
    """
    readers = dict(_READERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"]):
                ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
                data = bytes(data or b"")
                row = {"path": path, "reader": None, "text": None, "title": None, "meta": "{}", "authors": [], "bytes_sha": hashlib.sha256(data).hexdigest(), "text_sha": None, "problem": None}
                if ext not in readers:
                    row["problem"] = f"no extractor for '{ext}'"
                else:
                    try:
                        got = readers[ext](path, data)
                        row |= got | {"meta": json.dumps(got["meta"], default=str), "text_sha": hashlib.sha256(got["text"].encode("utf-8", "surrogatepass")).hexdigest()}
                    except Exception as problem:
                        row["problem"] = f"{type(problem).__name__}: {problem}"[:300]
                rows.append(row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)
