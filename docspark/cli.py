"""Command line: update, ask, backup, restore, reset.

    python -m docspark.cli --root /data/corpus ask "What is due in May?" --filter nature=contracts
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import SparkSession

from docspark import pipeline, update
from docspark.config import MODES, Retrieval
from docspark.operators import answers
from docspark.operators.retrieval import parse_filters
from docspark.operators.chunking import CHUNK
from docspark.sources import admin
from docspark.storage import Layout, read_version


def logger(name: str, path: str, level: int = logging.INFO) -> logging.Logger:
    """Writes to a file and the console; asked for again, it is the same."""
    log = logging.getLogger(name)
    if not log.handlers:
        log.setLevel(level)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        for handler in (logging.FileHandler(path, encoding="utf-8"), logging.StreamHandler()):
            handler.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(message)s"))
            log.addHandler(handler)
    return log


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docspark")
    top.add_argument("--root", required=True, help="folder of the tables")
    commands = top.add_subparsers(dest="command", required=True)
    up = commands.add_parser("update", help="convert, scan and extract, chunk, index")
    up.add_argument("--corpus", action="append", required=True, help="folder of documents (may be repeated)")
    up.add_argument("--convert-from", default="", help="folder of legacy office files")
    for flag in ("--scan-only", "--force", "--dry-run", "--keep-stale"):
        up.add_argument(flag, action="store_true")
    up.add_argument("--source", action="append", default=[], help="chunk and index this source only (may be repeated)")
    up.add_argument("--limit", type=int, default=0)
    ask = commands.add_parser("ask", help="answer a question")
    ask.add_argument("question")
    ask.add_argument("--mode", choices=sorted(MODES), default="recherche")
    ask.add_argument("--top-k", type=int, default=0)
    ask.add_argument("--max-per-source", type=int)
    ask.add_argument("--neighbors", type=int, default=1)
    ask.add_argument("--mmr", action="store_true")
    parents = ask.add_mutually_exclusive_group()
    parents.add_argument("--parents", dest="parents", action="store_true", default=None)
    parents.add_argument("--no-parents", dest="parents", action="store_false")
    ask.add_argument("--context-tokens", type=int, default=0)
    ask.add_argument("--filter", action="append", default=[], help="key=value; values of a repeated key are alternatives")
    backup = commands.add_parser("backup", help="copy the index and the registry")
    backup.add_argument("--name", default="")
    backup.add_argument("--zip", action="store_true")
    backup.add_argument("--no-registry", action="store_true")
    restore = commands.add_parser("restore", help="make a backup current")
    restore.add_argument("backup")
    restore.add_argument("--registry", action="store_true")
    restore.add_argument("--yes", action="store_true")
    reset = commands.add_parser("reset", help="empty tables")
    reset.add_argument("tables", nargs="+", choices=["registry", "extracted", "chunks", "index", "converted"])
    reset.add_argument("--yes", action="store_true")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict | list | str | None:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("docspark").getOrCreate()
    layout, out = Layout(args.root), None
    if args.command == "update":
        sources = tuple(args.source)
        out = update.run_update(
            spark, layout, update.Convert(bool(args.convert_from), args.convert_from, args.dry_run, args.force, args.keep_stale), update.Scan(roots=tuple(args.corpus), raw=args.convert_from, scan_only=args.scan_only),
            update.Chunk(not args.scan_only, args.force, sources, args.limit, args.keep_stale), update.Index(not args.scan_only, args.force, sources, args.limit, args.keep_stale),
        )
        if "://" not in (root := args.root.removeprefix("file://")):  # a log file is a local one
            for step, said in out.items():
                logger(f"docspark {root}", f"{root}/logs/update.log").info("%s | %s", step, json.dumps(said, ensure_ascii=False))
    elif args.command == "ask":
        config = Retrieval(args.mode, args.top_k, args.max_per_source, args.context_tokens, args.neighbors, parents=args.parents, mmr=args.mmr, filters=parse_filters(args.filter))
        questions = spark.createDataFrame([(0, args.question)], "qid int, question string")
        index = read_version(spark, layout.index)
        store = read_version(spark, layout.chunks, CHUNK)
        facts = index.select("source_id", "filename", "nature", "ext", "origin_path").dropDuplicates(["source_id"])
        done = pipeline.ask(questions, index, store.join(facts, "source_id", "left"), config)
        out = json.loads(answers.as_json(done, questions, args.mode, "local").first()["json"])
    elif args.command == "backup":
        out = admin.export(spark, layout, args.name, with_registry=not args.no_registry, zipped=args.zip)
    elif args.command == "restore":
        admin.restore(spark, layout, args.backup, args.registry, args.yes)
    else:
        out = admin.reset(spark, [getattr(layout, t) for t in args.tables], layout.root, args.yes)
    print(json.dumps(out, ensure_ascii=False, indent=2))
    return out


if __name__ == "__main__":
    main()
