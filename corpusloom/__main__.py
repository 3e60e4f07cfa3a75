"""Command line: python -m corpusloom COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom import queries
from corpusloom.operators import chunk, markdown, segment
from corpusloom.plans import claims, project
from corpusloom.sources import files


#: Commands over a project's folder.
PROJECT = {"init": "check a project's sources and pages", "doctor": "check all that a run needs", "extract": "facts of chunks", "deduplicate": "families of facts", "align": "decisions of sources", "run": "all stages of a project"}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done, 1: an error in the input, 2: something needs review."""
    parser = argparse.ArgumentParser(prog="corpusloom")
    todo = parser.add_subparsers(dest="command", required=True)
    todo.add_parser("list", help="names of queries")
    for name, text in (("query", "run a registered query"), ("parse", "documents or pages to chunks"), ("clean", "clean Markdown texts"), ("segment", "sentences of texts"), ("score", "decisions to scores"), ("export", "scores to CSV and Markdown"), ("status", "rows of a ledger's tables"), *PROJECT.items()):
        p = todo.add_parser(name, help=text)
        p.add_argument("data", help="folder of Parquet tables")
        if name == "query":
            p.add_argument("name")
        if name in PROJECT:
            p.add_argument("--models", help="module with extract, embed and align, functions of DataFrames")
            p.add_argument("--force", action="store_true", help="make the first stage and what hangs on it anew")
            if name == "run":
                p.add_argument("--from-stage", default="parse", choices=project.STAGES)
        elif name != "status":
            p.add_argument("out", help="folder to write to; it must be new")
        if name in ("parse", "clean", "segment"):
            p.add_argument("--table", default="documents")
            p.add_argument("--key", default="doc_id")
    a = parser.parse_args(args)
    if a.command == "list":
        print(*queries.QUERIES, sep="\n")
        return 0
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    read = lambda t: spark.read.parquet(f"{a.data}/{t}.parquet")
    try:
        if a.command == "query":
            if a.name not in queries.QUERIES:
                raise ValueError(f"no query {a.name}")
            queries.QUERIES[a.name](spark, a.data).write.parquet(a.out)
        elif a.command in PROJECT:
            return _project(a, spark)
        elif a.command == "parse":
            chunk.identify(chunk.chunk_pages(read(a.table), a.key), a.key, a.key).write.parquet(a.out)
        elif a.command == "clean":
            read(a.table).select(a.key, markdown.clean_column(F.col("text")).alias("text")).write.parquet(a.out)
        elif a.command == "segment":
            read(a.table).select(a.key, F.posexplode(segment.segment(F.col("text"))).alias("pos", "s")).select(a.key, "pos", "s.*").write.parquet(a.out)
        elif a.command == "score":
            facts, sources, decisions = read("facts"), read("sources"), read("decisions")
            if not claims.incomplete(facts, sources, decisions).isEmpty():
                print("some facts lack a source's decision", file=sys.stderr)
                return 2
            claims.score_facts(facts, decisions, read("evidence"), sources).write.parquet(a.out)
        elif a.command == "export":
            rows = claims.ledger_rows(claims.ledger_order(read("scores")), claims.source_buckets(read("decisions"), read("sources").select("source", "title")))
            files.write_ledger(rows, f"{a.out}/ledger")
            files.write_report(claims.report(rows), f"{a.out}/report")
        else:
            print(*(f"{t}: {read(t).count()}" for t in ("facts", "sources", "decisions", "evidence")), sep="\n")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _project(a, spark: SparkSession) -> int:
    given = importlib.import_module(a.models) if a.models else None
    plan = project.Project(spark, a.data, project.Models(given.extract, given.embed, given.align) if given else None)
    checks = plan.checks()
    if a.command in ("init", "doctor"):
        print(*(f"{'ok' if ok else 'OPEN'}: {what}" for what, ok in checks), sep="\n")
        return 0 if all(ok for what, ok in checks if what != "models" or a.command == "doctor") else 1
    if given is None and (a.command != "run" or project.STAGES.index(a.from_stage) < project.STAGES.index("score")):
        raise ValueError("this stage needs --models")
    told = plan.run(a.from_stage, a.force) if a.command == "run" else {a.command: getattr(plan, a.command)(a.force)}
    print(*(f"{stage}: {counts}" for stage, counts in told.items()), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
