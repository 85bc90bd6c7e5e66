import io
import json

import pytest
from pyspark.sql import functions as F

from stratum.api import cli, tools
from stratum.plans import ingest, layers
from stratum.sources import chats
from stratum.sources.config import AppConfig, ProjectConfig, Room, init_project
from stratum.store import Store
from stratum.streaming.refresh import watch

NOTE = "Kai prefers Rust because the borrow checker helps. We decided to use the new architecture on 2024-03-05.\n" * 3
CODE = "def login(user):\n    return check(user.password) and audit(user)\n" * 20
CHAT = "> how do we deploy the api server to production today\nUse the pipeline.\n\n> and the database\nRun the migration first, then restart.\n\n> thanks a lot for all of that help\nSure.\n"


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    for name, text in {"auth/login.py": CODE, "design/notes.md": NOTE, "node_modules/x.js": CODE, "bin.dat": "x", "auth/tiny.py": "x = 1", ".gitignore": "a" * 99}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "auth/bad.txt").write_bytes(b"\xff\xfe" * 100)
    (root / "auth/big.txt").write_text("y" * 600_000)
    init_project(str(root), "proj")
    return root


def test_mine_search_and_mine_again(spark, project, tmp_path):
    config = ProjectConfig.load(str(project))
    assert [r.name for r in config.rooms] == ["auth", "design", "general"]
    store = Store(spark, str(tmp_path / "store"))
    assert ingest.mine(store, str(project), config, dry_run=True).added > 0 and store.read("drawers").count() == 0
    done = ingest.mine(store, str(project), config)
    assert (done.seen, done.skipped, done.rooms) == (4, 1, {"auth": 1, "design": 1}) and done.added == store.read("drawers").count()
    assert ingest.mine(store, str(project), config).added == 0
    raw = store.read("drawers").where("drawer_type = 'drawer'")
    assert raw.where("source_file = 'auth/login.py'").count() > 1
    note = raw.where("source_file = 'design/notes.md'").first()
    assert (note.room, note.hall, note.date, note.wing) == ("design", "hall_facts", "2024-03-05", "proj")
    assert store.read("vectors").count() == store.read("drawers").count()
    facts = {(r.subject, r.predicate, r.object) for r in store.read("triples").collect()}
    assert facts == {("kai", "prefers", "rust")}  # decided_to_use is below the gate

    t = tools.Tools(store)
    top = t.call("search", {"query": "borrow checker helps", "limit": 3})["results"]
    assert top[0]["id"] == note.id and top[0]["drawer_type"] == "drawer"
    assert [f["object"] for f in t.call("kg_query", {"entity": "Kai"})["facts"]] == ["Rust"]
    text = layers.wake_up(store.read("drawers"), str(tmp_path / "none"))
    assert "## L1 — ESSENTIAL STORY" in text and "[design]" in text and "(notes.md)" in text

    (project / "design/notes.md").write_text(NOTE.replace("Rust", "Zig"))
    again = ingest.mine(store, str(project), config)
    assert again.rooms == {"design": 1} and not store.read("drawers").where("active and content like '%Rust%'").count()
    totals = ingest.compress(store)
    assert totals["added"] > 0 and totals["ratio"] > 1 and ingest.compress(store)["added"] == 0
    story = layers.story(store.read("drawers"), prefer_compressed=True)
    assert "|" in story and "0:KAI" in story


def test_chats(spark, tmp_path):
    root = tmp_path / "chats"
    root.mkdir()
    (root / "a.txt").write_text(CHAT)
    (root / "b.json").write_text(json.dumps([{"role": "user", "content": "we decided on kafka because it scales well"}, {"role": "assistant", "content": [{"type": "text", "text": "noted"}]}]))
    config = ProjectConfig("talk", [Room("general")])
    store = Store(spark, str(tmp_path / "store"))
    done = ingest.mine(store, str(root), config, chat=True)
    raw = store.read("drawers").where("drawer_type = 'drawer'")
    assert done.seen == 2 and raw.where("source_file = 'a.txt'").count() == 3
    assert {r.room for r in raw.collect()} >= {"technical"}
    assert ingest.mine(Store(spark, str(tmp_path / "other")), str(root), config, chat=True, general=True).added > 0


@pytest.mark.parametrize("form", [
    "\n".join(json.dumps({"type": t, "message": {"content": c}}) for t, c in [("human", "hi"), ("assistant", [{"type": "text", "text": "yo"}]), ("system", "x")]) + "\nnot json",
    json.dumps({"messages": [{"role": "human", "content": "hi"}, {"role": "system", "content": "x"}, {"role": "ai", "content": {"text": "yo"}}]}),
    json.dumps({"mapping": {"r": {"parent": None, "message": None, "children": ["a"]}, "a": {"parent": "r", "message": {"author": {"role": "user"}, "content": {"parts": ["hi"]}}, "children": ["b", "r"]},
                            "b": {"parent": "a", "message": {"author": {"role": "assistant"}, "content": {"parts": ["yo"]}}, "children": ["a"]}}}),
    json.dumps([{"type": "message", "user": "u1", "text": "hi"}, {"type": "join"}, {"type": "message", "username": "u2", "text": "yo"}]),
])
def test_chat_forms(form):
    assert chats.normalise("x.json", form) == "> hi\nyo\n\n"


def test_malformed_chats_stay_as_they_are():
    for text in ('[{"role": "user"}, {"role": "user", "content": "a"}]', "{not json", "plain", '{"a": 1}'):
        assert chats.normalise("x.json", text) == text
    assert chats.normalise("x.json", None) is None


@pytest.fixture
def small_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    t = tools.Tools(store, env={tools.WRITE_FLAG: "1"})
    for wing, room, content in [("alpha", "auth", "The login flow uses signed cookies"), ("beta", "auth", "Tokens are rotated every night"), ("beta", "ops", "Deploys happen on Tuesday mornings")]:
        assert t.call("add_drawer", {"wing": wing, "room": room, "content": content})["success"]
    return store, t


def test_tools(small_store):
    store, t = small_store
    assert t.call("status")["total_drawers"] == 3 and t.call("list_wings")["wings"] == {"beta": 2, "alpha": 1}
    assert t.call("list_rooms", {"wing": "none"})["rooms"] is None and t.call("get_taxonomy")["taxonomy"]["beta"] == {"auth": 1, "ops": 1}
    assert [x["room"] for x in t.call("find_tunnels", {"wing_a": "alpha", "wing_b": "beta"})["tunnels"]] == ["auth"]
    assert [(r["room"], r["hop"]) for r in t.call("traverse", {"start_room": "ops"})["rooms"]] == [("ops", 0), ("auth", 1)]
    assert [r["connected_via"] for r in t.call("traverse", {"start_room": "ops"})["rooms"]] == [None, ["beta"]]
    assert t.call("traverse", {"start_room": "aut"})["suggestions"] == ["auth"]
    same = t.call("check_duplicate", {"content": "The login flow uses signed cookies", "threshold": 0.5})
    assert same["is_duplicate"] and t.call("check_duplicate", {"content": "The login flow uses signed cookies", "threshold": 99})["threshold"] == 1.0
    assert t.call("get_compact_context", {"wing": "alpha", "limit": 5})["items"][0]["content"].startswith("The login")
    assert t.call("graph_stats")["tunnel_rooms"] == 1 and "Header" in t.call("get_dialect_spec")["spec"]
    for entry in ("first day", "second day"):
        t.call("diary_write", {"agent_name": "Agent K", "entry": entry})
    assert {e["content"] for e in t.call("diary_read", {"agent_name": "Agent K"})["entries"]} == {"first day", "second day"}
    t.call("kg_add", {"subject": "Kai", "predicate": "owns", "object": "Auth", "valid_from": "2024-01-01"})
    t.call("kg_invalidate", {"subject": "Kai", "predicate": "owns", "object": "Auth", "ended": "2024-05-01"})
    assert t.call("kg_stats")["expired_facts"] == 1 and t.call("kg_timeline", {"entity": "Kai"})["timeline"][0]["valid_to"] == "2024-05-01"
    gone = t.call("search", {"query": "Tuesday mornings"})["results"][0]["id"]
    assert t.call("delete_drawer", {"drawer_id": gone})["deleted"] == 1
    for bad in ({"query": " "}, {"query": "?!"}, {"query": "x" * 2001}):
        with pytest.raises(tools.ToolError):
            t.call("search", bad)


def test_changes_need_the_flag(small_store):
    store, _ = small_store
    t = tools.Tools(store, env={})
    assert "add_drawer" not in t.names() and "search" in t.names()
    with pytest.raises(tools.ToolError, match="disabled"):
        t.call("add_drawer", {})


def test_messages(small_store):
    store, _ = small_store
    asked = [{"id": 1, "method": "initialize"}, {"method": "notify"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "nope"}}, {"id": 4, "method": "x"}]
    frames = b"".join(b"Content-Length: %d\r\n\r\n%s" % (len(m), m) for m in (json.dumps(a).encode() for a in asked[:3])) + b"\n".join(json.dumps(a).encode() for a in asked[3:]) + b"\n{bad\n"
    sink = io.BytesIO()
    tools.serve(tools.Tools(store, env={}), io.BytesIO(frames), sink)
    sink.seek(0)
    out = []
    while (m := tools.read_message(sink)) is not None:
        out.append(json.loads(m))
    assert [o.get("id") for o in out] == [1, 2, 3, 4, None] and [o.get("error", {}).get("code") for o in out] == [None, None, -32602, -32601, -32700]


def test_the_server_outlives_bad_input():
    """Arrays, wrong types, bad frames and long messages are answered with an error, and the next request is served."""
    store = type("NoStore", (), {"spark": None, "path": ""})()
    good = b'{"id": 9, "method": "ping"}\n'
    for bad, code in (
        (b"[1, 2]\n", -32600), (b'"x"\n', -32600), (b'{"id": 1, "method": "ping", "params": [1]}\n', -32600), (b"Content-Length: x\r\n", -32600), (b"Content-Length: -5\r\n\r\n", -32600),
        (b"Content-Length: 3000000\r\n\r\n" + b"y" * 3_000_000, -32600), (b"z" * 3_000_000 + b"\n", -32600), (b"\xff\xfe\n", -32700),
        (b'{"id": 1, "method": "tools/call", "params": {"name": "search", "arguments": [1]}}\n', -32602), (b'{"id": 1, "method": "tools/call", "params": {"name": ["a"]}}\n', -32602),
    ):
        sink = io.BytesIO()
        tools.serve(tools.Tools(store, env={}), io.BytesIO(bad + good), sink)
        sink.seek(0)
        out = []
        while (m := tools.read_message(sink)) is not None:
            out.append(json.loads(m))
        assert out[0]["error"]["code"] == code and out[-1] == {"jsonrpc": "2.0", "id": 9, "result": {}} and len(out) == 2, bad[:40]


def test_every_tool_is_described():
    store = type("NoStore", (), {"spark": None, "path": ""})()
    t = tools.Tools(store, env={tools.WRITE_FLAG: "1"})
    assert sorted(t.names()) == sorted(tools.INVENTORY) and len(tools.INVENTORY) == 20
    for name, (what, arguments, required) in tools.INVENTORY.items():
        assert what and set(required) <= set(arguments), name


def test_long_and_wordless_queries(small_store):
    store, t = small_store
    assert len(t._search("token " * 250, 5).collect()) <= 5
    hits = t._search("?!", 5).collect()
    assert len(hits) == 3 and {h.lexical_score for h in hits} == {0.0}


def test_stream_of_files(spark, tmp_path):
    source = tmp_path / "in"
    store, config = Store(spark, str(tmp_path / "store")), ProjectConfig("w", [Room("general")])
    for i, text in enumerate((NOTE, NOTE, NOTE.replace("Rust", "Zig"))):
        spark.createDataFrame([("a.md", text)], "source_file string, content string").write.mode("append").parquet(str(source))
        files = spark.readStream.schema("source_file string, content string").parquet(str(source))
        q = watch(files, store, config, str(tmp_path / "ck"))
        q.awaitTermination()
        n = store.read("drawers").where("active and drawer_type = 'drawer'").count()
        assert n == 1, i
    assert "Zig" in store.read("drawers").where("active and drawer_type = 'drawer'").first().content


def test_benchmark_and_cli(spark, tmp_path):
    data = {"documents": [{"id": "d1", "wing": "w", "room": "r", "content": "alpha beta gamma"}, {"id": "d2", "wing": "w", "room": "r", "content": "delta epsilon"}], "queries": [{"id": "q", "query": "delta epsilon", "relevant_ids": ["d2"]}]}
    (tmp_path / "set.json").write_text(json.dumps(data))
    lines = [{"kind": "document", **d} for d in data["documents"]] + [{"kind": "query", **q} for q in data["queries"]] + [{"kind": "other"}]
    (tmp_path / "set.jsonl").write_text("\n".join(map(json.dumps, lines)))
    for name, backend in (("set.json", "hybrid"), ("set.jsonl", "fts"), ("set.json", "local")):
        out = io.StringIO()
        assert cli.main(["--home", str(tmp_path / "h"), "--store", str(tmp_path / backend), "benchmark", str(tmp_path / name), "--backend", backend], spark, out) == 0
        assert json.loads(out.getvalue()) == {"queries": 1, "recall_at_k": 1.0, "mrr": 1.0, "ndcg_at_k": 1.0}
    (tmp_path / "code").mkdir()
    out = io.StringIO()
    assert cli.main(["--home", str(tmp_path / "h"), "init", str(tmp_path / "code")], spark, out) == 0
    assert cli.main(["--home", str(tmp_path / "h"), "search", " "], spark, out) == 2
    assert cli.main(["--home", str(tmp_path / "h"), "--store", str(tmp_path / "none"), "wake-up"], spark, out) == 0 and "No memories yet" in out.getvalue()
    assert "recall" in cli.parser().format_help()
    assert AppConfig.load(str(tmp_path / "h"), env={"STRATUM_PATH": "/x"}).store_path == "/x"


def test_metrics_by_hand(spark):
    from stratum.operators import metrics

    results = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 1), ("q2", "d", 3)], "qid string, id string, rank int")
    relevant = spark.createDataFrame([("q1", "b"), ("q2", "d"), ("q2", "c"), ("q3", "x")], "qid string, id string")
    r = metrics.evaluate(results, relevant, spark.createDataFrame([("q1",), ("q2",), ("q3",)], "qid string"), 2).select(*(F.round(c, 4).alias(c) for c in ("recall_at_k", "mrr", "ndcg_at_k"))).first()
    assert tuple(r) == (round(2 / 3, 4), 0.5, round((0.63093 + 1 / 1.63093) / 3, 4))


def test_semantic_scores_cover_whole_contents(spark):
    from stratum.functions.embed import embed_column
    from stratum.plans import bench, search

    filler = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([("d1", "w", "r", f"{filler} quasar telescope", None), ("d2", "w", "r", "quasar telescope bread", None), ("d3", "w", "r", "bread", None)], "id string, wing string, room string, content string, source_file string")
    drawers = bench.as_drawers(docs).cache()
    asked = spark.createDataFrame([(1, "quasar telescope")], "qid long, query string")
    own = embed_column(None)
    want = {r.id: r.s for r in search.semantic.cosine_scores(drawers.select("id", own("content").alias("embedding")), asked.select("qid", own("query").alias("vector"))).select("id", F.round("semantic_score", 6).alias("s")).collect()}
    assert want["d1"] > 0
    got = {r.id: r.semantic_score for r in search.hybrid(drawers, asked).collect()}
    assert got["d1"] == want["d1"]
    # stored vectors of this backend are taken as they are, drawers without one are embedded
    stored = drawers.where("id = 'd2'").select(F.col("id").alias("drawer_id"), own(F.lit("quasar telescope")).alias("embedding"))
    label = search.provider(search.EmbeddingConfig.resolve("local", "builtin")).label.value
    got = {r.id: r.semantic_score for r in search.hybrid(drawers, asked, vectors=stored.withColumn("backend", F.lit(label))).collect()}
    assert got["d1"] == want["d1"] and got["d2"] == 1.0
    got = {r.id: r.semantic_score for r in search.hybrid(drawers, asked, vectors=stored.withColumn("backend", F.lit("other"))).collect()}
    assert got["d2"] == want["d2"]
