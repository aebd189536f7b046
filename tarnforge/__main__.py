"""``python -m tarnforge index|update|search|projects|stats STORE ...``"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tarnforge.api import Engine, as_text
from tarnforge.settings import Settings
from tarnforge.workspace import detect


def main() -> None:
    p = argparse.ArgumentParser(prog="tarnforge")
    p.add_argument("command", choices=["index", "update", "search", "projects", "stats"])
    p.add_argument("store", help="folder of the project's tables")
    p.add_argument("what", nargs="?", help="a folder to index, a query, or a project")
    p.add_argument("--mode", default="hybrid")
    p.add_argument("--limit", type=int)
    p.add_argument("--settings")
    a = p.parse_args()
    engine = Engine(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a.store, Settings.read(a.settings))
    if a.command in ("index", "update"):
        engine.init()
        print(json.dumps(getattr(engine, a.command)(a.what or detect().path)))
    elif a.command == "search":
        print(as_text(engine.search(a.what or "", a.mode, a.limit), engine.store(), engine.settings.result_chars))
    elif a.command == "projects":
        print("\n".join(engine.projects()))
    else:
        print(json.dumps(engine.project_stats(a.what or ""), default=str))


if __name__ == "__main__":
    main()
