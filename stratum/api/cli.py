"""The command line: init, mine, search, status, wake-up, compress, serve, benchmark."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from stratum.functions.embed import EmbeddingConfig
from stratum.sources.config import AppConfig, ProjectConfig, Room, init_project


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratum", description="Layered text memory on Spark: mine files and chats, then recall, search and trace them.")
    p.add_argument("--store")
    p.add_argument("--home")
    for name in ("backend", "local-provider", "model", "api-key", "base-url"):
        p.add_argument(f"--embedding-{name}")
    sub = p.add_subparsers(dest="command", required=True)
    own = sub.add_parser("init", help="write the configuration of a project")
    own.add_argument("dir")
    own = sub.add_parser("mine", help="mine a folder of files or chats")
    own.add_argument("dir")
    own.add_argument("--mode", choices=["projects", "convos"], default="projects")
    own.add_argument("--wing")
    own.add_argument("--agent", default="stratum")
    own.add_argument("--limit", type=int)
    own.add_argument("--dry-run", action="store_true")
    own.add_argument("--force", action="store_true")
    own.add_argument("--extract", choices=["exchange", "general"], default="exchange")
    own = sub.add_parser("search", help="search memories")
    own.add_argument("query")
    own.add_argument("--wing")
    own.add_argument("--room")
    own.add_argument("--results", type=int, default=5)
    sub.add_parser("status", help="count what is stored")
    own = sub.add_parser("wake-up", help="recall identity and story")
    own.add_argument("--wing")
    own = sub.add_parser("compress", help="add compact lines to raw memories")
    own.add_argument("--wing")
    own.add_argument("--dry-run", action="store_true")
    own = sub.add_parser("serve", help="serve the tools over stdio")
    own.add_argument("--transport", choices=["stdio"], default="stdio")
    own = sub.add_parser("benchmark", help="measure retrieval")
    own.add_argument("dataset")
    own.add_argument("--backend", choices=["fts", "local", "onnx", "openai", "hybrid"], default="hybrid")
    own.add_argument("--k", type=int, default=5)
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("stratum").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None, spark=None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    config = AppConfig.load(args.home, args.store)
    say = lambda *x: print(*x, file=out)
    if args.command == "init":
        from stratum.functions import vocab

        path = Path(args.dir).resolve()
        name = path.name if path.name not in vocab.GENERIC_NAMES or path.parent.name in ("", *vocab.GENERIC_NAMES) else path.parent.name
        say("wrote", init_project(str(path), name))
        say("wrote", config.save(args.home or os.path.dirname(config.identity_file)))
        return 0
    if args.command == "search" and not args.query.strip():
        print("the query is empty", file=sys.stderr)
        return 2
    embedding = EmbeddingConfig.resolve(
        args.embedding_backend or config.embedding_backend, args.embedding_local_provider or config.local_provider, args.embedding_model or config.embedding_model, args.embedding_api_key,
        args.embedding_base_url or config.embedding_url,
    )
    embedding.validate()

    from stratum.plans import bench, ingest, layers
    from stratum.store import Store

    spark = spark or session()
    store = Store(spark, config.store_path)
    if args.command == "mine":
        chat = args.mode == "convos"
        project = ProjectConfig(args.wing or Path(args.dir).resolve().name, [Room("general")]) if chat else ProjectConfig.load(args.dir)
        if args.wing:
            project.wing = args.wing
        done = ingest.mine(store, args.dir, project, chat, args.agent, args.limit, args.extract == "general", args.dry_run, args.force, embedding)
        say(f"files: {done.seen}, skipped: {done.skipped}, rows {'planned' if args.dry_run else 'added'}: {done.added}")
        for room, n in done.rooms.items():
            say(f"  {room}: {n}")
    elif args.command == "search":
        say(layers.search(store.read("drawers"), args.query, args.wing, args.room, args.results, embedding, store.read("vectors")))
    elif args.command == "status":
        from stratum.api.tools import Tools

        say(json.dumps(Tools(store, config).call("status"), indent=2, default=str))
    elif args.command == "wake-up":
        flag = os.environ.get("STRATUM_PREFER_COMPRESSED", "").lower() in ("1", "true", "yes", "on")
        say(layers.wake_up(store.read("drawers"), config.identity_file, args.wing, flag))
    elif args.command == "compress":
        say(json.dumps(ingest.compress(store, args.wing, args.dry_run)))
    elif args.command == "serve":
        from stratum.api.tools import Tools, serve

        serve(Tools(store, config, embedding), sys.stdin.buffer, sys.stdout.buffer)
    else:
        docs, asked = bench.load(spark, args.dataset)
        batch = bench.as_drawers(docs)
        store.refresh(batch)
        say(json.dumps(bench.run(store.read("drawers"), asked, args.backend, args.k, embedding, store.read("vectors")).first().asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
