"""Tools over a store, called by name with arguments; the message loop that serves them."""

from __future__ import annotations

import datetime
import json
import os
import re
import uuid
from collections.abc import Callable
from typing import IO

from pyspark.sql import functions as F

from stratum import schema
from stratum.functions import text as X
from stratum.functions.embed import EmbeddingConfig, embed_column, provider
from stratum.functions.names import slug
from stratum.operators import drawers as D
from stratum.operators import kg, rooms
from stratum.plans import search
from stratum.sources.config import AppConfig
from stratum.store import Store

WRITE_FLAG = "STRATUM_ENABLE_WRITES"
PROTOCOL = "Look facts up before answering about the past; record what changed after a session."
DIALECT = "Compact memory lines. Header: wing|room|date|source. Line: 0:ENTITIES|topics|\"key sentence\"|emotions|FLAGS; empty parts are left out."
_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}
#: Of each tool what it is for, its arguments, and which of them are required.
INVENTORY: dict[str, tuple[str, dict, list[str]]] = {
    "status": ("Counts of drawers by wing, room and type, and how to use the store", {}, []),
    "list_wings": ("Wings and their numbers of drawers", {}, []),
    "list_rooms": ("Rooms and their numbers of drawers, of one wing or of all", {"wing": _TEXT}, []),
    "get_taxonomy": ("Numbers of drawers by wing and room", {}, []),
    "get_dialect_spec": ("How compact lines are written", {}, []),
    "get_compact_context": ("The newest drawers in scope, in compact form where there is one", {"wing": _TEXT, "room": _TEXT, "limit": _NUMBER}, []),
    "search": ("Search by words and meaning", {"query": _TEXT, "limit": _NUMBER, "wing": _TEXT, "room": _TEXT}, ["query"]),
    "check_duplicate": ("Whether a text is stored already", {"content": _TEXT, "threshold": {"type": "number"}}, ["content"]),
    "kg_query": ("Facts about an entity, now or at a date", {"entity": _TEXT, "as_of": _TEXT, "direction": {"type": "string", "enum": ["outgoing", "incoming", "both"]}}, ["entity"]),
    "kg_timeline": ("Facts in order of time, of one entity or of all", {"entity": _TEXT}, []),
    "kg_stats": ("Numbers of entities and facts", {}, []),
    "traverse": ("Rooms reached from a room through shared wings", {"start_room": _TEXT, "max_hops": _NUMBER}, ["start_room"]),
    "find_tunnels": ("Rooms that several wings share", {"wing_a": _TEXT, "wing_b": _TEXT}, []),
    "graph_stats": ("Numbers of rooms, shared rooms and links", {}, []),
    "diary_read": ("The newest diary entries of an agent", {"agent_name": _TEXT, "last_n": _NUMBER}, ["agent_name"]),
    "add_drawer": ("Store a text, unless it is there already", {"wing": _TEXT, "room": _TEXT, "content": _TEXT, "source_file": _TEXT, "added_by": _TEXT}, ["wing", "room", "content"]),
    "delete_drawer": ("Delete a drawer for good", {"drawer_id": _TEXT}, ["drawer_id"]),
    "kg_add": ("Record a fact", {"subject": _TEXT, "predicate": _TEXT, "object": _TEXT, "valid_from": _TEXT, "source_closet": _TEXT}, ["subject", "predicate", "object"]),
    "kg_invalidate": ("End a fact", {"subject": _TEXT, "predicate": _TEXT, "object": _TEXT, "ended": _TEXT}, ["subject", "predicate", "object"]),
    "diary_write": ("Write a diary entry of an agent", {"agent_name": _TEXT, "entry": _TEXT, "topic": _TEXT}, ["agent_name", "entry"]),
}
WRITES = ("add_drawer", "delete_drawer", "kg_add", "kg_invalidate", "diary_write")


class ToolError(ValueError):
    """A call that cannot be answered; it is reported and the server goes on."""


def writes_enabled(env=os.environ) -> bool:
    return env.get(WRITE_FLAG, "").lower() in ("1", "true", "yes", "on")


def _text(args: dict, name: str, most: int | None = None) -> str:
    value = args.get(name)
    if not isinstance(value, str) or not value.strip():
        raise ToolError(f"{name} is required")
    if most is not None and len(value) > most:
        raise ToolError(f"{name} has more than {most} characters")
    return value


def _number(args: dict, name: str, default, lo, hi):
    value = args.get(name, default)
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise ToolError(f"{name} must be a number")
    return min(max(value, lo), hi)


def _rows(df) -> list[dict]:
    return [json.loads(json.dumps(r.asDict(recursive=True), default=str)) for r in df.collect()]


class Tools:
    def __init__(self, store: Store, config: AppConfig | None = None, embedding: EmbeddingConfig | None = None, env=os.environ):
        self.store, self.config, self.embedding, self.env = store, config, embedding, env
        self.spark = store.spark

    # -- what there is

    def names(self) -> list[str]:
        own = [n[5:] for n in dir(self) if n.startswith("tool_")]
        return [n for n in own if n not in WRITES or writes_enabled(self.env)]

    def call(self, name: str, args: dict | None = None):
        if name in WRITES and not writes_enabled(self.env):
            raise ToolError(f"{name} is disabled: set {WRITE_FLAG}=1 to allow changes")
        tool: Callable | None = getattr(self, f"tool_{name}", None)
        if tool is None:
            raise ToolError(f"unknown tool {name}")
        return tool(args or {})

    # -- reading

    def drawers(self):
        return self.store.read("drawers")

    def graph(self):
        return rooms.nodes(self.drawers())

    def tool_status(self, args):
        rows = self.drawers()
        return {
            "total_drawers": rows.where("active").count(), "wings": {r.wing: r.rooms for r in D.taxonomy_map(rows).collect()},
            "drawer_types": {r.drawer_type: r.n for r in D.by_type(rows).collect()}, "store": self.store.path, "protocol": PROTOCOL,
        }

    def tool_list_wings(self, args):
        return {"wings": {r.wing: r.n for r in D.top_wings(self.drawers(), 100).collect()}}

    def tool_list_rooms(self, args):
        all_ = {r.wing: r.rooms for r in D.taxonomy_map(self.drawers()).collect()}
        return {"rooms": all_.get(args["wing"]) if args.get("wing") else all_}

    def tool_get_taxonomy(self, args):
        return {"taxonomy": {r.wing: r.rooms for r in D.taxonomy_map(self.drawers()).collect()}}

    def tool_get_dialect_spec(self, args):
        return {"spec": DIALECT}

    def tool_get_compact_context(self, args):
        rows = D.compact_context(self.drawers(), args.get("wing"), args.get("room"), int(_number(args, "limit", 10, 1, 50)))
        return {"items": _rows(rows.select("id", "wing", "room", X.preferred_snippet(F.col("content"), F.col("compressed"), True, 300).alias("content"), "compressed_id"))}

    def _search(self, query: str, limit: int, wing=None, room=None):
        asked = self.spark.createDataFrame([(1, query.strip())], "qid long, query string")
        return search.hybrid(self.drawers(), asked, limit, wing, room, self.embedding, self.store.read("vectors"))

    def tool_search(self, args):
        query = _text(args, "query", schema.MAX_QUERY_CHARS)
        if not re.search("[A-Za-z0-9_-]{2,}", query):
            raise ToolError("query has no word of two characters or more")
        hits = self._search(query, int(_number(args, "limit", 5, 1, 50)), args.get("wing"), args.get("room"))
        return {"query": query, "results": _rows(hits.drop("qid").orderBy("rank"))}

    def tool_check_duplicate(self, args):
        content, threshold = _text(args, "content"), _number(args, "threshold", 0.85, 0.0, 1.0)
        from stratum.operators.semantic import duplicates

        found = _rows(duplicates(self._search(content, 5), threshold).select("id", "wing", "room", "duplicate_score", "snippet"))
        return {"is_duplicate": bool(found), "threshold": threshold, "matches": found}

    def tool_kg_query(self, args):
        entity, direction = _text(args, "entity"), args.get("direction", "both")
        facts = kg.query(self.store.read("triples"), self.store.read("entities"), entity, args.get("as_of"), direction)
        return {"entity": entity, "as_of": args.get("as_of"), "facts": _rows(facts)}

    def tool_kg_timeline(self, args):
        return {"entity": args.get("entity") or "all", "timeline": _rows(kg.timeline(self.store.read("triples"), self.store.read("entities"), args.get("entity")))}

    def tool_kg_stats(self, args):
        return _rows(kg.stats(self.store.read("triples"), self.store.read("entities")))[0]

    def tool_traverse(self, args):
        start, graph = _text(args, "start_room"), self.graph()
        found = rooms.traverse(graph, start, int(_number(args, "max_hops", 2, 1, 6))).join(graph, "room")
        found = _rows(found.select("room", "hop", "wings", "halls", "n", "dates", "drawer_types", "connected_via").orderBy("hop", "room"))
        return {"start": start, "rooms": found} if found else {"error": f"no room {start}", "suggestions": [r.room for r in rooms.suggestions(graph, start).collect()]}

    def tool_find_tunnels(self, args):
        return {"tunnels": _rows(rooms.tunnels(self.graph(), args.get("wing_a"), args.get("wing_b")).select("room", "wings", "n", "dates"))}

    def tool_graph_stats(self, args):
        return _rows(rooms.stats(self.graph()))[0]

    def tool_diary_read(self, args):
        agent = _text(args, "agent_name")
        rows = D.diary(self.drawers(), agent, int(_number(args, "last_n", 10, 1, 100)))
        return {"agent": agent, "entries": _rows(rows.select("id", "date", "filed_at", "content"))}

    # -- writing

    def _add(self, prefix: str, wing: str, room: str, content: str, **own) -> str:
        now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        row = dict.fromkeys(schema.DRAWERS.names) | {
            "id": f"{prefix}_{uuid.uuid4().hex}", "wing": wing, "room": room, "content": content, "filed_at": now, "chunk_index": 0, "active": True, "source_file": "", "drawer_type": schema.DRAWER,
        } | own
        row["source_file"] = row["source_file"] or row["id"]  # rows of no source do not supersede each other
        batch = self.spark.createDataFrame([tuple(row[n] for n in schema.DRAWERS.names)], schema.DRAWERS)
        label = provider(self.embedding or EmbeddingConfig.resolve("local", "builtin")).label.value
        vectors = batch.select(F.col("id").alias("drawer_id"), embed_column(self.embedding)(F.col("content")).alias("embedding"), F.lit(label).alias("backend"))
        self.store.refresh(batch, vectors)
        return row["id"]

    def tool_add_drawer(self, args):
        wing, room, content = _text(args, "wing"), _text(args, "room"), _text(args, "content", schema.MAX_QUERY_CHARS)
        found = self.call("check_duplicate", {"content": content})
        if found["is_duplicate"]:
            return {"success": False, "reason": "duplicate", "matches": found["matches"]}
        new = self._add("drawer", wing, room, content, source_file=args.get("source_file") or "", added_by=args.get("added_by") or "tool")
        return {"success": True, "drawer_id": new, "wing": wing, "room": room}

    def tool_delete_drawer(self, args):
        which = _text(args, "drawer_id")
        return {"drawer_id": which, "deleted": self.store.delete([which])}

    def tool_diary_write(self, args):
        agent, entry = _text(args, "agent_name"), _text(args, "entry")
        today = datetime.date.today().isoformat()
        new = self._add("diary", f"wing_{slug(agent)}", "diary", entry, hall="hall_diary", date=today, drawer_type=schema.DIARY, added_by=agent)
        return {"success": True, "entry_id": new, "agent": agent, "topic": args.get("topic", "general")}

    def tool_kg_add(self, args):
        fact = [_text(args, n) for n in ("subject", "predicate", "object")]
        new = self.spark.createDataFrame([(*fact, args.get("valid_from"), 1.0, args.get("source_closet"), None)], "subject string, predicate string, object string, valid_from string, confidence double, source_closet string, source_file string")
        now = F.current_timestamp()
        names = new.select(F.col("subject").alias("name")).union(new.select("object"))
        self.store.write_all({"entities": kg.with_entities(self.store.read("entities"), names, now), "triples": kg.add(self.store.read("triples"), new, now)})
        return {"success": True, "fact": " → ".join(fact)}

    def tool_kg_invalidate(self, args):
        fact = [_text(args, n) for n in ("subject", "predicate", "object")]
        which = self.spark.createDataFrame([(*fact, args.get("ended"))], "subject string, predicate string, object string, ended string")
        self.store.write("triples", kg.invalidate(self.store.read("triples"), which))
        return {"success": True, "fact": " → ".join(fact), "ended": args.get("ended") or datetime.datetime.now(datetime.timezone.utc).date().isoformat()}


# ---- messages -------------------------------------------------------------------------------------


def described(name: str) -> dict:
    what, arguments, required = INVENTORY[name]
    return {"name": name, "description": what, "inputSchema": {"type": "object", "properties": arguments, "required": required}}


def _skip(stream: IO[bytes], size: int) -> None:
    while size > 0 and (part := stream.read(min(size, 1 << 16))):
        size -= len(part)


def read_message(stream: IO[bytes]) -> bytes | None:
    """A message framed by Content-Length, or a line; None at the end. What is too long or badly framed is read past and reported."""
    most = schema.MAX_MESSAGE_BYTES
    line = stream.readline(most + 1)
    while line in (b"\n", b"\r\n"):
        line = stream.readline(most + 1)
    if not line:
        return None
    if len(line) > most:
        while line and not line.endswith(b"\n"):
            line = stream.readline(1 << 16)
        raise ToolError("the message is too long")
    if not line.lower().startswith(b"content-length:"):
        return line
    try:
        size = int(line.split(b":", 1)[1])
    except ValueError:
        raise ToolError("Content-Length is not a number") from None
    while (header := stream.readline(most)) and header.strip():
        pass
    if size < 0 or size > most:
        _skip(stream, size)
        raise ToolError("the message is too long" if size > 0 else "Content-Length is negative")
    return stream.read(size)


def answer(tools: Tools, message: bytes) -> dict | None:
    try:
        asked = json.loads(message)
    except ValueError as e:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
    if not isinstance(asked, dict) or not isinstance(asked.get("params") or {}, dict):
        return {"jsonrpc": "2.0", "id": asked.get("id") if isinstance(asked, dict) else None, "error": {"code": -32600, "message": "a request is an object whose params are one"}}
    method, params = asked.get("method"), asked.get("params") or {}
    if "id" not in asked:
        return None
    out = {"jsonrpc": "2.0", "id": asked["id"]}
    try:
        if method == "initialize":
            result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "stratum", "version": "0.1.0"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [described(n) for n in tools.names()]}
        elif method == "tools/call":
            if not isinstance(params.get("arguments") or {}, dict):
                raise ToolError("arguments are an object")
            value = tools.call(str(params.get("name", "")), params.get("arguments"))
            result = {"content": [{"type": "text", "text": json.dumps(value, indent=2, default=str)}]}
        else:
            return out | {"error": {"code": -32601, "message": f"no method {method}"}}
        return out | {"result": result}
    except ToolError as e:
        return out | {"error": {"code": -32602, "message": str(e)}}
    except Exception as e:  # noqa: BLE001  the server outlives a failed call
        return out | {"error": {"code": -32603, "message": f"{type(e).__name__}: {str(e)[:500]}"}}


def serve(tools: Tools, source: IO[bytes], sink: IO[bytes]) -> None:
    while True:
        try:
            message = read_message(source)
            if message is None:
                return
            out = answer(tools, message)
        except ToolError as e:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": str(e)}}
        if out is not None:
            body = json.dumps(out).encode()
            sink.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
            sink.flush()
