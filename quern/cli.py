"""Command line: add-dir, remove-dir, list-dirs, index, search, config and status."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from quern.api import Config, Engine
from quern.embedders import hash_embedder, http_embedder, plain_http
from quern.operators.catalog import root_named
from quern.session import build_session
from quern.sources.readers import vision_reader

#: Settable keys and how their values are read.
def bounded(least: int, most: int):
    """A reader of whole numbers within bounds."""

    def read(text: str) -> int:
        n = int(text)
        if not least <= n <= most:
            raise ValueError(text)
        return n

    return read


def one_of(*values: str):
    def read(text: str) -> str:
        if text not in values:
            raise ValueError(text)
        return text

    return read


KEYS = {
    "store": str, "model": str, "embed_url": str, "embed_kind": one_of("hash", "plain", "listed"), "embed_key": str, "overlap": bounded(0, 2000), "workers": bounded(1, 1000),
    "ocr_engine": one_of("local", "vision"), "ocr_url": str, "ocr_model": str, "ocr_key_command": str,
    "suffixes": lambda v: tuple(v.split(",")), "skip": lambda v: tuple(v.split(",")),
}
URLS = ("embed_url", "ocr_url")
USER_ERROR, DEGRADED, INTERRUPTED = 1, 3, 130


def load(path: Path) -> dict:
    """Settings, or none where the file is absent or broken."""
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
        return found if isinstance(found, dict) else {}
    except (OSError, ValueError):
        return {}


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description="Search local documents with Spark.")
    p.add_argument("--home", default=os.path.expanduser("~/.quern"))
    p.add_argument("--version", action="version", version="quern 0.1")
    c = p.add_subparsers(dest="command")
    a = c.add_parser("add-dir")
    a.add_argument("path")
    a.add_argument("--images", action="store_true")
    c.add_parser("remove-dir").add_argument("path")
    c.add_parser("list-dirs")
    i = c.add_parser("index")
    i.add_argument("--full", action="store_true")
    i.add_argument("--workers", type=positive)
    s = c.add_parser("search")
    s.add_argument("query", nargs="+")
    for flag in ("--semantic", "--both", "--strict", "--json"):
        s.add_argument(flag, action="store_true")
    s.add_argument("--limit", type=positive, default=10)
    s.add_argument("--dir")
    s.add_argument("--max-chars", type=positive)
    k = c.add_parser("config").add_subparsers(dest="what")
    k.add_parser("show")
    put = k.add_parser("set")
    put.add_argument("key")
    put.add_argument("value")
    c.add_parser("status").add_argument("--json", action="store_true")
    return p


def lines_of(rows) -> list[str]:
    out = []
    for r in rows:
        out += [f"[{r['score']:.2f}] {r['path']}", *([f"  {r['heading']}"] if r["heading"] else []), f"  {r['snippet']}", ""]
    return out or ["No results."]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 0
    home = Path(args.home)
    home.mkdir(parents=True, exist_ok=True)
    at = home / "config.json"
    kept = load(at)
    save = lambda: at.write_text(json.dumps(kept, indent=2, ensure_ascii=False), encoding="utf-8")
    roots = kept.setdefault("directories", [])
    if args.command == "add-dir":
        path = os.path.abspath(os.path.expanduser(args.path))
        if not os.path.isdir(path):
            print(f"no such folder: {path}", file=sys.stderr)
            return USER_ERROR
        kept["directories"] = [*dict.fromkeys([*roots, path])]
        if args.images:
            kept["images"] = [*dict.fromkeys([*kept.get("images", []), path])]
        save()
        return 0
    if args.command == "list-dirs":
        print("\n".join(roots))
        return 0
    if args.command == "config":
        if args.what == "set":
            if args.key not in KEYS:
                print(f"no such setting: {args.key}", file=sys.stderr)
                return USER_ERROR
            try:
                kept[args.key] = KEYS[args.key](args.value)
            except ValueError:
                print(f"not a value for {args.key}: {args.value}", file=sys.stderr)
                return USER_ERROR
            if args.key in URLS and args.value and plain_http(args.value):
                print(f"{args.key} is not HTTPS: texts and keys travel unencrypted", file=sys.stderr)
            save()
        else:
            print(json.dumps(kept, indent=2, ensure_ascii=False))
        return 0
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in kept.items() if k in Config.__dataclass_fields__}
    spark = build_session()
    if args.command == "index" and args.workers:
        known["workers"] = args.workers
    folder = kept.get("store", str(home / "store"))
    url, kind, model = kept.get("embed_url", ""), kept.get("embed_kind", "hash"), kept.get("model", "hash-8")
    embedder = hash_embedder(8) if kind == "hash" else http_embedder(url, model, kept.get("embed_key", ""), kind == "listed")
    images = None
    if kept.get("ocr_engine") == "vision" and kept.get("ocr_url"):
        command = kept.get("ocr_key_command", "")
        key = subprocess.run(command, shell=True, capture_output=True, text=True, check=False).stdout.strip() if command else ""  # the user's own setting
        images = vision_reader(kept["ocr_url"], kept.get("ocr_model", ""), key)
    engine = Engine(spark, folder, Config(**known), embedder, image_text=images)
    if args.command == "remove-dir":
        root = root_named(roots, os.path.abspath(os.path.expanduser(args.path))) or root_named(roots, args.path)
        if root is None:
            print(f"not indexed: {args.path}", file=sys.stderr)
            return USER_ERROR
        engine.store.remove_root(root)
        kept["directories"] = [r for r in roots if r != root]
        save()
        return 0
    if args.command == "index":
        if not roots:
            print("add a folder first", file=sys.stderr)
            return USER_ERROR
        print(json.dumps(engine.index(args.full)))
        return 0
    if args.command == "status":
        row = engine.status().first().asDict(recursive=True)
        print(json.dumps(row, indent=2, ensure_ascii=False) if args.json else "\n".join(f"{k}: {v}" for k, v in row.items()))
        return 0
    hits = engine.search(" ".join(args.query), args.limit, args.semantic, args.both, args.strict, os.path.abspath(args.dir) if args.dir else None, args.max_chars)
    if args.json:
        rows = [json.loads(r["j"]) for r in hits.rows.select(F.to_json(F.struct("*")).alias("j")).collect()]
        print(json.dumps(rows, indent=2, ensure_ascii=False))
    else:
        print("\n".join(lines_of(hits.rows.collect())))
    return DEGRADED if hits.degraded else 0


if __name__ == "__main__":
    try:
        sys.exit(main())
    except KeyboardInterrupt:
        sys.exit(INTERRUPTED)
