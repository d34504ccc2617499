"""Maintenance from the command line: ``python -m tidemark PATH snapshot|compact|vacuum|stats [--setting value ...]``.

Settings are those of `config.Limits`: a flag counts, then the environment, then the default.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import fields

from .config import Limits


def arguments(argv: Sequence[str] | None = None) -> tuple[argparse.Namespace, Limits]:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("path")
    parser.add_argument("command", choices=("snapshot", "compact", "vacuum", "stats"))
    parser.add_argument("--master")
    parser.add_argument("--keep", type=int, default=0, help="commits that vacuum leaves")
    for f in fields(Limits):
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=int)
    found = parser.parse_args(argv)
    given = {f.name: getattr(found, f.name) for f in fields(Limits) if getattr(found, f.name) is not None}
    return found, Limits.resolve(**given)


def main(argv: Sequence[str] | None = None) -> dict:
    from .engine import Engine
    from .session import session

    found, limits = arguments(argv)
    engine = Engine(session(found.master), found.path, limits)
    done = {"snapshot": lambda: {"snapshot_offset": engine.snapshot()}, "compact": lambda: {"dropped": engine.compact()}, "vacuum": lambda: {"dropped": engine.compact(), "removed": engine.retain(found.keep)}, "stats": engine.stats}[found.command]()
    print(json.dumps(done))
    return done


if __name__ == "__main__":
    main()
