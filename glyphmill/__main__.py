"""python -m glyphmill STORE [--config FILE] COMMAND ...: index, search, fetch, list, stats, health; prints one JSON line per row."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from glyphmill.config import Settings, as_bool, as_int, as_mode
from glyphmill.operators import catalog
from glyphmill.plans.maintenance import Index


def parser() -> argparse.ArgumentParser:
    """The arguments of all commands."""
    top = argparse.ArgumentParser(prog="glyphmill", description=__doc__)
    top.add_argument("store")
    top.add_argument("--config")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("--full", nargs="?", const="yes")
    index.add_argument("--source")
    index.add_argument("--seconds", type=float)
    search = commands.add_parser("search")
    search.add_argument("query")
    for name in ("mode", "top-k", "sort", "source", "date-from", "date-to"):
        search.add_argument(f"--{name}")
    fetch = commands.add_parser("fetch")
    for name in ("chunk-id", "doc-id", "path", "ext-id", "offset", "max-chars"):
        fetch.add_argument(f"--{name}")
    listing = commands.add_parser("list")
    for name in ("source", "date-from", "date-to", "title-contains", "order", "limit", "offset"):
        listing.add_argument(f"--{name}")
    commands.add_parser("stats")
    commands.add_parser("health")
    return top


def rows_of(index: Index, args: argparse.Namespace) -> tuple[DataFrame | None, dict]:
    """(rows to print, what is said beside them) of one command."""
    store, settings = index.store, index.settings
    number = lambda v, default, low, high: as_int(v, default, low, high)
    if args.command == "index":
        runs = index.reindex(as_bool(args.full), args.source, args.seconds)
        return None, {"runs": [{"source": r.source_id, "locked": r.locked, "notes": r.notes, **r.counts} for r in runs]}
    if args.command == "search":
        mode, note = as_mode(args.mode)
        limits = settings["search"]
        found = index.search(
            args.query, mode=mode, top_k=number(args.top_k, limits["default_top_k"], 1, limits["max_top_k"]), sort=args.sort or "relevance",
            source=args.source, date_from=args.date_from, date_to=args.date_to, max_per_doc=limits["max_per_doc"], k=limits["rrf_k"],
        )
        return found.rows, {"mode": found.mode, "arms": found.arms, "suppressed": found.suppressed, "notes": [*([note] if note else []), *found.notes]}
    if args.command == "fetch":
        named = {k: None if v is None else int(v) for k, v in (("chunk_id", args.chunk_id), ("doc_id", args.doc_id))}
        window = {"offset": number(args.offset, 0, 0, 2**31), "max_chars": number(args.max_chars, 20_000, 1, 200_000)}
        return catalog.fetch(store.read("docs"), store.read("chunks"), **named, path=args.path, ext_id=args.ext_id, **window), {}
    if args.command == "list":
        rows = catalog.list_documents(
            store.read("docs"), args.source, args.date_from, args.date_to, args.title_contains, order=args.order or "date_desc",
            limit=number(args.limit, 50, 1, 200), offset=number(args.offset, 0, 0, 2**31),
        )
        return rows.select("doc_id", "source_id", "rel_path", "title", "date", "state"), {}
    if args.command == "stats":
        return catalog.source_summary(store.read("docs")), {"states": {r["state"]: r["n"] for r in catalog.state_counts(store.read("docs")).collect()}}
    return index.health(), {}


def main(argv: list[str] | None = None) -> int:
    """Run one command."""
    args = parser().parse_args(argv)
    index = Index(SparkSession.builder.getOrCreate(), args.store, Settings.load(args.config))
    try:
        rows, said = rows_of(index, args)
    except (ValueError, RuntimeError, FileNotFoundError) as e:
        print(json.dumps({"error": str(e)}, ensure_ascii=False))
        return 1
    for line in rows.toJSON().toLocalIterator() if rows is not None else ():
        print(line)
    if said:
        print(json.dumps(said, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
