"""Chat exports, brought to one form: user turns as quoted lines, each followed by its reply.

JSON forms differ in shape from file to file and one of them is a walk along a tree, so they are
read by an Arrow UDF over whole files; turns that are rows already are rendered by aggregation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

USER, ASSISTANT = ("user", "human"), ("assistant", "ai")


def transcripts(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, transcript, n_messages of rows of (keys, turn, role, text); other roles are dropped, and so are chats under two messages."""
    role = F.when(F.col("role").isin(*USER), "user").when(F.col("role").isin(*ASSISTANT), "assistant")
    own = turns.select(*keys, "turn", role.alias("role"), F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text")).where("role is not null")
    after = F.lead("role").over(Window.partitionBy(*keys).orderBy("turn"))
    own = own.withColumn("_after", after)
    end = F.when((F.col("role") == "user") & F.col("_after").eqNullSafe(F.lit("assistant")), "\n").otherwise("\n\n")
    line = F.concat(F.when(F.col("role") == "user", "> ").otherwise(""), F.col("text"), end)
    out = own.select(*keys, "turn", line.alias("line")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("t"), F.count("*").alias("n_messages"))
    return out.where("n_messages >= 2").select(*keys, F.array_join(F.transform("t", lambda x: x["line"]), "").alias("transcript"), "n_messages")


def _text(content) -> str:
    """The text of a content value: a string, a list of strings and text items, or an object with text."""
    if isinstance(content, str):
        return content.strip()
    if isinstance(content, list):
        parts = [x if isinstance(x, str) else x.get("text", "") if isinstance(x, dict) and x.get("type") == "text" else "" for x in content]
        return " ".join(p for p in parts if isinstance(p, str) and p).strip()
    if isinstance(content, dict):
        return str(content.get("text", "")).strip()
    return ""


def event_log(text: str) -> list | None:
    out = []
    for line in text.splitlines():
        try:
            item = json.loads(line)
        except ValueError:
            continue
        if isinstance(item, dict) and item.get("type") in ("human", "assistant"):
            body = _text((item.get("message") or {}).get("content") if isinstance(item.get("message"), dict) else None)
            if body:
                out.append(("user" if item["type"] == "human" else "assistant", body))
    return out if len(out) >= 2 else None


def role_items(data) -> list | None:
    items = data.get("messages") if isinstance(data, dict) else data
    if not isinstance(items, list):
        return None
    out = []
    for item in items:
        if not isinstance(item, dict) or not isinstance(item.get("role"), str) or "content" not in item:
            return None  # a malformed item rejects the file
        body = _text(item["content"])
        if body and item["role"] in USER + ASSISTANT:
            out.append(("user" if item["role"] in USER else "assistant", body))
    return out if len(out) >= 2 else None


def message_tree(data) -> list | None:
    """Along the first children from the root. Nodes without a message are passed over."""
    tree = data.get("mapping") if isinstance(data, dict) else None
    if not isinstance(tree, dict):
        return None
    tops = [k for k, v in tree.items() if isinstance(v, dict) and v.get("parent") is None]
    at = next((k for k in tops if tree[k].get("message") is None), tops[0] if tops else None)
    out, seen = [], set()
    while at is not None and at not in seen:
        seen.add(at)
        node = tree.get(at) or {}
        message = node.get("message")
        if isinstance(message, dict):
            role = (message.get("author") or {}).get("role")
            parts = (message.get("content") or {}).get("parts") or []
            body = " ".join(p for p in parts if isinstance(p, str) and p).strip()
            if body and role in ("user", "assistant"):
                out.append((role, body))
        at = next(iter(node.get("children") or []), None)
    return out if len(out) >= 2 else None


def channel(data) -> list | None:
    """The first speaker is the user; each further one takes the role that the last message did not have."""
    if not isinstance(data, list):
        return None
    out, roles, last = [], {}, None
    for item in data:
        if not isinstance(item, dict) or item.get("type") != "message":
            continue
        who, body = item.get("user") or item.get("username") or "", str(item.get("text") or "").strip()
        if not who or not body:
            continue
        if who not in roles:
            roles[who] = "assistant" if last == "user" else "user"
        last = roles[who]
        out.append((last, body))
    return out if len(out) >= 2 else None


def rendered(messages: list[tuple[str, str]]) -> str:
    out = []
    for i, (role, body) in enumerate(messages):
        answered = role == "user" and i + 1 < len(messages) and messages[i + 1][0] == "assistant"
        out.append(("> " if role == "user" else "") + body + ("\n" if answered else "\n\n"))
    return "".join(out)


def normalise(path: str | None, content: str | None) -> str | None:
    """Transcripts as they are; known JSON forms rendered; anything else unchanged."""
    if content is None:
        return None
    if sum(line.lstrip().startswith(">") for line in content.splitlines()) >= 3:
        return content
    if (path or "").lower().endswith((".json", ".jsonl")) or content.lstrip()[:1] in ("{", "["):
        found = event_log(content)
        if found is None:
            try:
                data = json.loads(content)
            except ValueError:
                return content
            for form in (role_items, message_tree, channel):
                found = form(data)
                if found is not None:
                    break
        if found is not None:
            return rendered(found)
    return content


@F.pandas_udf(T.StringType())
def _normalised(path: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([normalise(p, c) for p, c in zip(path, content, strict=True)])


def normalised(path: Column, content: Column) -> Column:
    return _normalised(path, content)
