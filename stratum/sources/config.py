"""Configuration files and small texts, read and written on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from stratum.functions import vocab

NAMES = ("stratum.yaml", "rooms.yaml")


@dataclass
class Room:
    name: str
    keywords: list[str] = field(default_factory=list)


@dataclass
class ProjectConfig:
    wing: str
    rooms: list[Room]

    @classmethod
    def load(cls, folder: str) -> ProjectConfig:
        """The project's file, or its older name; a room ``general`` is added if there is none."""
        import yaml

        for name in NAMES:
            path = Path(folder) / name
            if path.exists():
                data = yaml.safe_load(path.read_text()) or {}
                rooms = [Room(r["name"], [str(k) for k in r.get("keywords") or []]) for r in data.get("rooms") or []]
                if all(r.name != "general" for r in rooms):
                    rooms.append(Room("general"))
                return cls(str(data["wing"]), rooms)
        raise FileNotFoundError(f"no {NAMES[0]} in {folder}: run init first")

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, r.name, r.keywords) for i, r in enumerate(self.rooms)], "ord int, name string, keywords array<string>")


def init_project(folder: str, wing: str) -> Path:
    """Write the project's file unless there is one: ``general`` and the folders at the top are its rooms."""
    path = Path(folder) / NAMES[0]
    if not path.exists():
        own = {p.name for p in Path(folder).iterdir() if p.is_dir() and p.name not in vocab.SKIP_DIRS}
        rooms = sorted({"general", *own})
        path.write_text(f"wing: {json.dumps(wing)}\nrooms:\n" + "".join(f"  - name: {json.dumps(r)}\n    keywords: []\n" for r in rooms))
    return path


@dataclass
class AppConfig:
    store_path: str
    identity_file: str
    embedding_backend: str | None = None
    embedding_model: str | None = None
    embedding_url: str | None = None
    local_provider: str | None = None

    @classmethod
    def load(cls, home: str | None = None, store: str | None = None, env=os.environ) -> AppConfig:
        """The store's path from the argument, then two variables, the file, the default; embedding fields from variables, the file, the default."""
        base = Path(home or env.get("STRATUM_HOME") or os.path.expanduser("~/" + vocab.STORE_DIR))
        try:
            data = json.loads((base / "config.json").read_text())
            data = data if isinstance(data, dict) else {}
        except (OSError, ValueError):
            data = {}
        path = store or env.get("STRATUM_PATH") or env.get("STRATUM_STORE") or data.get("store_path") or str(base / "store")
        get = lambda name, key: env.get(name) or data.get(key)
        return cls(
            os.path.expanduser(path), os.path.expanduser(data.get("identity_file") or str(base / "identity.txt")), get("STRATUM_EMBEDDING_BACKEND", "embedding_backend"),
            get("STRATUM_EMBEDDING_MODEL", "embedding_model"), get("STRATUM_EMBEDDING_URL", "embedding_url"), get("STRATUM_LOCAL_EMBEDDING_PROVIDER", "local_provider"),
        )

    def save(self, home: str) -> Path:
        """Write config.json unless there is one."""
        path = Path(home) / "config.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        if not path.exists():
            path.write_text(json.dumps({k: v for k, v in asdict(self).items() if v is not None}, indent=2))
        return path


def identity(path: str) -> str:
    try:
        return Path(path).read_text().strip()
    except OSError:
        return "## L0 — IDENTITY\nNo identity configured. Write one to the identity file."
