"""Named arguments to a command line, for programs that call commands by name; and what a results folder holds."""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping
from typing import Any

from ..sources.tables import ContractError
from .engine import RESULTS, Engine, describe

#: Entries of a results folder that are listed.
ENTRIES = 500
#: Options that a command cannot do without.
NEEDED = {"ingest": ("cells",), "run": ("cells", "base_type", "target_type"), "hplot": ("base_type", "target_type"), "agg": ("name", "types"), "cci": ("lr_pairs",)}


def options(parser: argparse.ArgumentParser) -> dict[str, argparse.Action]:
    """Options by the name of their first long flag, with underscores."""
    return {a.option_strings[0].lstrip("-").replace("-", "_"): a for a in parser._actions if a.option_strings and a.dest != "help"}


def to_argv(parser: argparse.ArgumentParser, command: str, args: Mapping[str, Any]) -> list[str]:
    """The command and its flags in the parser's order. None leaves an option out, a switch is given only if its value is true, lists are
    joined by commas. Unknown and missing options are refused, all of them in one message."""
    known = options(parser)
    unknown = sorted(set(args) - set(known))
    missing = [n for n in NEEDED.get(command, ()) if args.get(n) is None]
    if unknown or missing:
        raise ContractError("; ".join(f"{what} options of {command}: {', '.join(names)}" for what, names in (("unknown", unknown), ("missing", missing)) if names))
    out = [command]
    for name, action in known.items():
        value = args.get(name)
        if value is None:
            continue
        flag = action.option_strings[0]
        if action.nargs == 0:
            out += [flag] if value else []
        else:
            items = [str(v) for v in value] if isinstance(value, (list, tuple)) else [str(value)]
            if isinstance(value, (list, tuple)) and any(c.isspace() or c == "," for item in items for c in item):
                raise ContractError(f"items of {name} may hold no blanks or commas, which part lists; write t_cell for 't cell'")
            out.append(f"{flag}={','.join(items)}")
    return out


def layout(engine: Engine) -> dict[str, Any]:
    """The tables below the results folder with their partitions, of which at most ``ENTRIES`` in all; ``more`` tells that there are others."""
    tables: dict[str, list[str]] = {}
    left = ENTRIES
    more = False
    for name in ("cells", "expression", "graph_edges", *RESULTS):
        path, fs = engine._files(engine.path(name))
        if not fs.exists(path):
            continue
        names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
        tables[name] = names[:left]
        more |= len(names) > left
        left -= len(tables[name])
    return {"root": engine.root, "tables": tables, "more": more}


def schema(parser: argparse.ArgumentParser) -> dict[str, Any]:
    """All commands with their status, options and needed options."""
    found = json.loads(describe())
    listed = [{"name": n, "flag": a.option_strings[0], "switch": a.nargs == 0, "default": a.default, "choices": list(a.choices) if a.choices else None} for n, a in options(parser).items()]
    for name, command in found["commands"].items():
        command["needed"] = list(NEEDED.get(name, ()))
    return found | {"options": listed}
