"""Exports of assistants as turns: line-wise logs and conversation maps."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.text import parse_instant

_BLOCK = "array<struct<type:string,text:string,thinking:string,name:string,id:string,input:string,content:string>>"


def log_turns(lines: DataFrame) -> DataFrame:
    """Turns of line-wise logs: input ``value`` (a JSON object a line), output one row a message.

    Columns ``session, external_id, parent_external_id, role, model, content, thinking, created_at, tools``.
    Content may be a string or a list of blocks; lines that are no messages or no JSON are left out.
    """
    get = lambda p: F.get_json_object("value", p)
    raw = get("$.message.content")
    blocks = F.from_json(raw, _BLOCK)
    text = F.array_join(F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), lambda t: t.isNotNull()), "\n\n")
    rows = lines.select(
        get("$.sessionId").alias("session"), get("$.uuid").alias("external_id"), get("$.parentUuid").alias("parent_external_id"), F.coalesce(get("$.message.role"), get("$.type")).alias("role"), get("$.message.model").alias("model"),
        F.when(raw.startswith("["), F.nullif(text, F.lit(""))).otherwise(raw).alias("content"), F.nullif(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "thinking"), lambda b: b["thinking"]), "\n\n"), F.lit("")).alias("thinking"),
        parse_instant(get("$.timestamp")).alias("created_at"), F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), b["input"].alias("arguments"))).alias("tools"),
    )
    return rows.where(F.col("external_id").isNotNull() & F.col("role").isin("user", "assistant", "system", "tool"))


_NODE = "map<string, struct<id:string, parent:string, message:struct<id:string, author:struct<role:string>, create_time:double, content:struct<parts:array<string>>, metadata:struct<model_slug:string>>>>"


def map_turns(conversations: DataFrame) -> DataFrame:
    """Turns of conversation maps: input ``value`` (a JSON conversation a row). Nodes without a message are left out."""
    nodes = conversations.select(F.coalesce(F.get_json_object("value", "$.conversation_id"), F.get_json_object("value", "$.id")).alias("session"), F.get_json_object("value", "$.current_node").alias("current"), F.explode(F.from_json(F.get_json_object("value", "$.mapping"), _NODE)).alias("key", "node"))
    m = F.col("node.message")
    return nodes.where(m.isNotNull()).select(
        "session", F.col("key").alias("external_id"), F.col("node.parent").alias("parent_external_id"), m["author"]["role"].alias("role"), m["metadata"]["model_slug"].alias("model"),
        F.nullif(F.array_join(m["content"]["parts"], "\n"), F.lit("")).alias("content"), F.timestamp_micros((m["create_time"] * 1000000).cast("long")).alias("created_at"), (F.col("current") == F.col("key")).alias("current"),
    )


_ITEM = r"<(?:\w+:)?(?:\w*item|\w*entry)[\s>/]"


@F.pandas_udf(T.LongType())
def _xml_items(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Elements whose local name ends in item or entry, of texts that are well-formed XML; else null."""

    def count(text: str | None) -> int | None:
        if text is None or "<" not in text or "<!DOCTYPE" in text:  # no entities from outside
            return None
        try:
            return sum(e.tag.rsplit("}", 1)[-1].lower().endswith(("item", "entry")) for e in ElementTree.fromstring(text.strip()).iter() if isinstance(e.tag, str))
        except ElementTree.ParseError:
            return None

    for texts in it:
        yield texts.map(count).astype("Int64")


def feed_items(text):
    """Number of items of a feed: of a JSON feed; else of elements of well-formed XML, where there are any; else of what looks like their tags."""
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    trimmed = F.regexp_replace(plain, r"^\s+|\s+$", "")
    json = F.when(trimmed.startswith("{") & trimmed.endswith("}"), F.size(F.from_json(F.get_json_object(trimmed, "$.items"), "array<string>")))
    xml = _xml_items(F.when(json.isNull(), plain))
    return F.coalesce(json.cast("long"), F.when(xml > 0, xml), F.regexp_count(plain, F.lit("(?i)" + _ITEM)).cast("long"))
