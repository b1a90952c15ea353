"""Text rules of ingest and facts as column expressions; composition and line ends are one Arrow function, the rest stays in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reply and forward marks of subjects, path rules, word lists and tool names.
SUBJECT_MARKS = "re fw fwd aw sv vs wg antw".split()
VENDORED = "node_modules vendor third_party 3rd_party thirdparty external externals deps dependencies Pods Carthage site-packages bower_components submodules subprojects".split()
PATH_RULES = [
    ("Reference/*", "reference", "path:Reference"), ("Documents/Paper/Reference/*", "reference", "path:Paper/Reference"), ("Documents/Reference/*", "reference", "path:Documents/Reference"), ("**/Army Field Manuals/*", "reference", "path:field-manuals"),
    ("**/Documentation/*", "reference", "path:Documentation"), ("**/Datasheets/*", "reference", "path:Datasheets"), ("**/Manuals/*", "reference", "path:Manuals"), ("**/Books/*", "reference", "path:Books"),
    ("**/Papers/*", "reference", "path:Papers"), ("**/Specs/*", "reference", "path:Specs"), ("**/RFCs/*", "reference", "path:RFCs"), ("Personal/*", "authored", "path:Personal"),
    ("Projects/*", "authored", "path:Projects"), ("Documents/Research/*", "authored", "path:Documents/Research"), ("Documents/Paper/*", "authored", "path:Documents/Paper"), ("Notes/*", "authored", "path:Notes"),
]
REFERENCE_PARTS = "reference references papers manuals datasheets books".split()
TEMPORAL = (
    "january february march april june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec "
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri yesterday today tomorrow tonight morning afternoon evening night before after earlier later"
).split()
NEGATION = "not no never none neither nor without cannot nobody nothing".split()
TOOLS = {
    "mcp": "call_mcp_tool list_resources read_resource", "subagent": "task agent dispatch_agent invoke_subagent define_subagent manage_subagents swarm send_message", "browser": "webfetch web_fetch open_url navigate_page",
    "read": "read notebookread read_file view_file view_file_outline view_code_item list_dir", "write": "write edit multiedit notebookedit write_file edit_file replace_file_content multi_replace_file_content apply_patch canmore.create_textdoc canmore.update_textdoc",
    "exec": "bash run_command command_status send_command_input exec_command write_stdin shell local_shell container.exec python", "search": "grep glob ls websearch web_search toolsearch grep_search find_by_name search_web search",
}
TOOL_STARTS = {"mcp": ("mcp_",), "browser": ("browser_",)}
TOOL_PATHS = ("file_path", "path", "Path", "TargetFile", "DirectoryPath", "SearchPath", "notebook_path", "workdir", "cwd")
TOOL_COMMANDS = ("command", "CommandLine", "cmd")
READERS = {
    "markdown": "md markdown mdx mkd", "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx xlsm", "image": "png jpg jpeg gif tiff tif bmp webp heic",
    "code": "py rs go js ts tsx jsx java kt c h cc cpp hpp cs rb php swift scala sql sh lua hs r pl", "plaintext": "txt text log rst csv tsv json yaml yml toml ini xml html htm tex org adoc", "mail": "eml emlx msg",
}
LEGACY_OFFICE, CONTAINERS = "doc xls ppt".split(), "zip gz tar 7z rar dmg iso exe dll so dylib bin jar class o a mp3 mp4 mov wav".split()


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob whose ``*`` spans slashes, with ``?`` and ``[!...]``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append("\\" + c if c in r"\.^$+(){}|[]" else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


@F.pandas_udf(T.StringType())
def nfc(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical composition, which Spark lacks."""
    for s in it:
        yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def canonical(t: str) -> str:
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
    t = t.replace("\0", "").replace("\r\n", "\n").replace("\r", "\n")
    t = "\n".join([x.rstrip(" \t\f\x0b") for x in t.split("\n")])
    return _BLANK_LINES.sub("\n\n\n", t).strip(" \t\n\x0b\f\r")


_BLANK_LINES = re.compile("\n{4,}")


@F.pandas_udf(T.StringType())
def normalize(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical text: composed, no NUL, one kind of line end, no trailing spaces, at most two blank lines."""
    for s in it:
        yield s.map(lambda t: t if t is None else canonical(t))


def normalize_code(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def guess_title(text: Column, stem: Column) -> Column:
    """The first heading of the first 40 lines, else the first line of 3 to 200 characters of the first 10, else the stem."""
    lines = F.split(text, "\n")
    head = F.filter(F.slice(lines, 1, 40), lambda x: x.rlike(r"^#\s+\S"))
    first = F.filter(F.transform(F.slice(lines, 1, 10), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x).between(3, 200))
    return F.coalesce(F.regexp_replace(F.get(head, F.lit(0)), r"^#\s+|\s+$", ""), F.get(first, F.lit(0)), stem)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.floor(F.length(text) / 4), F.lit(1)).cast("int")


def handle_key(handle: Column) -> Column:
    """A mail address in lower case, the digits of a phone number of seven or more, else null."""
    plain = F.regexp_replace(handle, r"^\s+|\s+$", "")
    digits = F.regexp_replace(plain, "[^0-9]", "")
    return F.when(plain.contains("@"), F.lower(plain)).when(F.length(digits) >= 7, digits)


def normalize_subject(subject: Column) -> Column:
    bare = F.regexp_replace(subject, rf"(?i)^(\s*((({'|'.join(SUBJECT_MARKS)})\s*(\[\d+\])?\s*:)|\[[^\]]*\])\s*)+", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def casefold(text: Column) -> Column:
    plain = F.translate(F.lower(text), "ſςµ", "sσμ")
    for a, b in (("ß", "ss"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return plain


def normalize_fact(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(casefold(text), r"\s+", " ")), r"[.!?;:,]+$", ""))


def claim_signature(text: Column) -> Column:
    """Numbers without separators, words of time, and whether the claim is negated; sorted and joined."""
    low = F.lower(text)
    numbers = F.transform(F.regexp_extract_all(low, F.lit(r"\d+(?:[.,]\d+)*"), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"[a-z]+(?:'[a-z]+)?"), 0)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), " ")
    return F.struct(
        joined(numbers).alias("numbers"),
        joined(F.filter(words, lambda w: w.isin(*TEMPORAL))).alias("temporal"),
        F.exists(words, lambda w: w.isin(*NEGATION) | w.endswith("n't")).alias("negated"),
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9_]+)$", 1))


def reader_for(path: Column) -> Column:
    """Reader of a file by its extension, or why there is none."""
    ext, out = extension(path), None
    for reader, words in READERS.items():
        test = ext.isin(*words.split())
        out = F.when(test, reader) if out is None else out.when(test, reader)
    return out.when(ext.isin(*LEGACY_OFFICE), "none: legacy binary format").when(ext.isin(*CONTAINERS), "none: binary container").otherwise("none: no extractor")


def corpus_class(reader: Column, default: Column) -> Column:
    """communication by the source's default or for mail, code by the reader, else document."""
    return F.when((default == "communication") | (reader == "mail"), "communication").when(reader == "code", "code").otherwise("document")


def path_trust(relative: Column, default: Column) -> Column:
    """Trust tier by path, with the rule's label: vendored folders, the rules in order, folder names, the default."""
    parts = F.split(relative, "/")
    pair = lambda trust, label: F.struct((trust if isinstance(trust, Column) else F.lit(trust)).alias("trust"), F.lit(label).alias("label"))
    out = F.when(F.arrays_overlap(parts, F.array(*map(F.lit, VENDORED))), pair("reference", "path:vendored"))
    for pattern, trust, label in PATH_RULES:
        out = out.when(relative.rlike(glob_regex(pattern)), pair(trust, label))
    low = F.transform(parts, F.lower)
    for part in REFERENCE_PARTS:
        out = out.when(F.array_contains(low, part), pair("reference", "path:component:" + part))
    return out.otherwise(pair(default, "path:default"))


def remote_owner(remote: Column) -> Column:
    """Owner part of a repository address: of a URL, of user@host:path, or after the first slash."""
    clean = F.regexp_replace(remote, r"\.git$", "")
    tail = F.when(clean.contains("://"), F.regexp_extract(clean, r"://[^/]*/?(.*)$", 1)).when(clean.rlike(r"^[^@]*@.*:"), F.regexp_extract(clean, r"^[^:]*:(.*)$", 1)).otherwise(F.regexp_replace(clean, r"^[^/]*/", ""))
    return F.nullif(F.regexp_extract(tail, r"^/*([^/]+)", 1), F.lit(""))


def tool_kind(name: Column) -> Column:
    low, out = F.lower(F.trim(name)), None
    for kind, words in TOOLS.items():
        test = low.isin(*words.split())
        for start in TOOL_STARTS.get(kind, ()):
            test = test | low.startswith(start)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def tool_argument(arguments: Column, keys: tuple[str, ...], most: int) -> Column:
    """The first non-blank text argument of these keys, cut to ``most`` characters."""
    return F.coalesce(*[F.nullif(F.substring(F.trim(F.get_json_object(arguments, f"$.{k}")), 1, most), F.lit("")) for k in keys])


def output_preview(text: Column, most: int = 1000) -> Column:
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.nullif(F.substring(plain, 1, most), F.lit(""))


def parse_instant(text: Column) -> Column:
    """Epoch seconds or milliseconds (above 1e11), or an ISO time, as a timestamp; else null."""
    number = text.try_cast("double")
    micros = F.when(number > 1e11, F.round(number * 1000)).otherwise(F.round(number * 1000000)).cast("long")
    return F.when(number > 0, F.timestamp_micros(micros)).when(number.isNull(), F.try_to_timestamp(F.trim(text)))


def table_slug(slug: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.lower(F.trim(slug)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(body != "", F.substring(F.concat(F.lit("emb_"), body), 1, 63))


def relation_label(label: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(label), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def one_line(text: Column, most: int = 300) -> Column:
    return F.replace(F.substring(text, 1, most), F.lit("\n"), F.lit(" "))


def home_tilde(path: Column, home: str) -> Column:
    return F.when(path == home, "~").when(path.startswith(home + "/"), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 20))).otherwise(path)


def tilde_home(path: Column, home: str) -> Column:
    return F.when(path == "~", home).when(path.startswith("~/"), F.concat(F.lit(home), F.substring(path, 2, 1 << 20))).otherwise(path)
