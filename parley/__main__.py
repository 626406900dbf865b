"""Command line: python -m parley COMMAND FOLDER ...; FOLDER holds a table of conversations."""

from __future__ import annotations

import argparse
import subprocess
import sys
import time

from pyspark.sql import SparkSession

from parley.operators import filters, imports, merge, render, summaries
from parley.sources import exports, files
from parley.sources.paged import fetch_details, function, read_listing
from parley.sources.snapshots import RunLock, SnapshotTable
from parley.streaming import cycle

#: Ends of a run: all done; something failed or was refused; (supervise) out of time; stopped early by its budget.
OK, FAILED, TIMED_OUT, EARLY = 0, 1, 2, 3


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="parley", description="Archived conversations")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        c.add_argument("folder")
        return c

    def chosen(c: argparse.ArgumentParser) -> None:
        c.add_argument("--after", help="a date or time; without zone it is UTC")
        c.add_argument("--before")
        c.add_argument("--model")
        c.add_argument("--date-field", choices=("created", "updated"), default="updated")
        c.add_argument("--limit", type=int, default=0)

    def run(c: argparse.ArgumentParser) -> None:
        c.add_argument("sources", nargs="+", help="NAME=LISTING,DETAILS with functions as module:name")
        c.add_argument("--batch-size", type=int, default=cycle.BATCH_ROWS)
        c.add_argument("--max-runtime-minutes", type=float)
        c.add_argument("--notify", help="module:name of a function of title and text")

    chosen(command("list", "print the stored conversations, newest first"))
    c = command("export", "write one file a conversation")
    c.add_argument("out")
    c.add_argument("--format", choices=("markdown", "text", "json"), default="markdown")
    c.add_argument("--no-metadata", action="store_true")
    chosen(c)
    c = command("show", "print one stored conversation")
    c.add_argument("source")
    c.add_argument("id")
    c.add_argument("--format", choices=("markdown", "text", "json"), default="markdown")
    c = command("backfill", "take in Markdown exports of the folders exports*")
    c.add_argument("root")
    c.add_argument("--dry-run", action="store_true")
    c = command("rehash", "make all hashes anew")
    c.add_argument("--dry-run", action="store_true")
    c = command("import", "fetch what listings have; ends with 3 where the time ran out first")
    run(c)
    chosen(c)
    c = command("poll", "run cycles over sources, from where the last clean one began")
    c.add_argument("state")
    run(c)
    c.add_argument("--overlap-minutes", type=int, default=cycle.OVERLAP_MINUTES)
    c.add_argument("--bootstrap-days", type=int, default=cycle.BOOTSTRAP_DAYS)
    c.add_argument("--interval", type=float, default=cycle.INTERVAL_SECONDS, help="seconds from cycle to cycle")
    c.add_argument("--once", action="store_true", help="one cycle only")
    c = command("supervise", "run imports again until one is done; ends with 1 where too many failed, 2 where the time ran out")
    c.add_argument("arguments", nargs=argparse.REMAINDER, help="what import takes after the folder")
    c.add_argument("--chunk-minutes", type=float, default=15)
    c.add_argument("--total-minutes", type=float, default=240)
    c.add_argument("--cooldown", type=float, default=30)
    c.add_argument("--crash-cooldown", type=float, default=120)
    c.add_argument("--max-failures", type=int, default=5)
    command("recent", "print what was stored last")
    return p


def source(spark: SparkSession, text: str) -> cycle.Source:
    name, _, functions = text.partition("=")
    listing, _, details = functions.partition(",")
    function(listing), function(details)  # a wrong name fails before the cycle

    def listed(after):
        from pyspark.sql import functions as F

        return read_listing(spark, listing, after).withColumn("pos", F.monotonically_increasing_id())  # one partition: the listing's order

    return cycle.Source(name, listed, lambda rows: fetch_details(rows, details))


def supervised(o: argparse.Namespace) -> int:
    """Runs the import command in processes of their own, each with a part of the time."""

    def chunk(budget: float) -> str:
        command = [sys.executable, "-m", "parley", "import", o.folder, *o.arguments, "--max-runtime-minutes", str(budget / 60)]
        code = subprocess.run(command, check=False).returncode
        if code not in (OK, EARLY):
            raise RuntimeError(f"import ended with {code}")
        return cycle.DONE if code == OK else cycle.STOPPED_EARLY

    ended, chunks = cycle.supervise(chunk, o.chunk_minutes * 60, o.total_minutes * 60, o.cooldown, o.crash_cooldown, o.max_failures)
    print(ended, f"{chunks} chunks", sep=": ")
    return {cycle.DONE: OK, cycle.GAVE_UP: FAILED}.get(ended, TIMED_OUT)


def imported(spark: SparkSession, table: SnapshotTable, o: argparse.Namespace) -> int:
    """Imports what the sources list, one after the other; stops where the time is used up."""
    code, left = OK, o.max_runtime_minutes * 60 if o.max_runtime_minutes is not None else None
    for text in o.sources:
        own = source(spark, text)
        began = time.monotonic()
        rows = imports.candidates(own.listing(o.after), own.name, table.read(), o.after, o.before, o.date_field, o.model, o.limit)
        send = function(o.notify) if o.notify else None
        stats = cycle.run_import(table, rows, own, o.batch_size, left, on_batch=lambda s, name=own.name: cycle.send_notes(spark, send, name, s))
        print(own.name, stats.counts | {"stopped_early": stats.stopped_early}, sep=": ")
        if left is not None:
            left = max(0.0, left - (time.monotonic() - began))
        code = EARLY if stats.stopped_early else code
    return code


def polled(spark: SparkSession, table: SnapshotTable, o: argparse.Namespace) -> int:
    last: list[int] = []

    def once() -> None:
        last[:] = [FAILED]
        budget = o.max_runtime_minutes * 60 if o.max_runtime_minutes is not None else None
        send = function(o.notify) if o.notify else None
        found = cycle.poll_cycle(table, cycle.state_table(spark, o.state), [source(spark, s) for s in o.sources], send=send, overlap_minutes=o.overlap_minutes, bootstrap_days=o.bootstrap_days, batch_rows=o.batch_size, budget_seconds=budget)
        for name, r in found.items():
            print(name, r if isinstance(r, str) else r.counts | {"stopped_early": r.stopped_early}, sep=": ", flush=True)
        last[:] = [int(any(isinstance(r, str) for r in found.values()))]

    failed = cycle.poll(once, o.interval, 1 if o.once else None)
    return FAILED if failed else last[0]


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    if o.command == "supervise":
        return supervised(o)
    spark = spark or SparkSession.builder.getOrCreate()
    table = SnapshotTable(spark, o.folder)
    if o.command in ("list", "export"):
        chosen = filters.select_conversations(table.read(), o.after, o.before, o.date_field, o.model, limit=o.limit)
        if o.command == "export":
            print(exports.write_exports(render.export_files(chosen, o.format, not o.no_metadata), o.out).count(), "files")
            return OK
        for r in summaries.newest_first(chosen).toLocalIterator():
            print(r.source, r.conversation_id, r.title or "(untitled)", sep="  ")
    elif o.command == "show":
        found = render.render(table.lookup(o.source, o.id), o.format).first()
        if found is None:
            print(f"no conversation {o.id} of {o.source}", file=sys.stderr)
            return FAILED
        print(found.content)
    elif o.command == "recent":
        for r in summaries.newest_imports(table.read()).collect():
            print(*r, sep="  ")
    else:
        with RunLock(spark, f"{o.folder.rstrip('/')}/_lock"):
            version = table.version()
            if o.command == "import":
                return imported(spark, table, o)
            if o.command == "poll":
                return polled(spark, table, o)
            if o.command == "backfill":
                merged, refused, counts = imports.backfill(table.read(), files.markdown_exports(spark, o.root))
                print(counts.first().asDict())
                for r in refused.toLocalIterator():
                    print(r.file_name, r.error, sep=": ")
            else:
                merged = merge.rehash(table.read())
                print(merge.rehash_report(merged).first().asDict())
            if not o.dry_run:
                table.replace(merged, expected=version)
    return OK


if __name__ == "__main__":
    raise SystemExit(main())
