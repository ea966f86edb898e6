"""Command line: build an index, pull data over REST, ask a question, serve."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from tidemark import web
from tidemark.plans import index, service
from tidemark.sources import rest


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("tidemark", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "ask", "serve"):
        p = sub.add_parser(name)
        p.add_argument("--data-root")
        p.add_argument("--index-dir")
        if name == "build":
            p.add_argument("--no-group", dest="group_tables", action="store_false", default=None)
        if name == "ask":
            p.add_argument("query")
            p.add_argument("--conversation", default=None)
        if name == "serve":
            p.add_argument("--host", default="127.0.0.1")
            p.add_argument("--port", type=int, default=8000)
            p.add_argument("--public")
    p = sub.add_parser("pull")
    for flag in ("--token-url", "--secret-file", "--access-header", "--list-url", "--detail-url", "--out"):
        p.add_argument(flag, required=flag in ("--list-url", "--out"))
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "pull":
        headers = {}
        if given.token_url:
            headers = {given.access_header: rest.token(given.token_url, given.access_header, rest.first_line(given.secret_file))}
        rest.pull_all(spark, given.list_url, given.detail_url, given.out, headers)
        return 0
    known = {k: v for k in ("data_root", "index_dir", "group_tables") if (v := getattr(given, k, None)) is not None}
    settings = index.Settings.from_env(dict(os.environ), **known)
    if given.command == "build":
        counts = index.build_index(spark, settings)
        index.save_settings(spark, settings, counts)
        print(counts)
        return 0
    own = service.Service(spark, service.Retriever.open(spark, settings), f"{settings.index_dir}/conversations", presets=settings.questions)
    if given.command == "ask":
        for piece in own.ask(given.query, given.conversation or own.new_conversation()):
            print(piece, end="", flush=True)
        print()
        return 0
    web.server(own, given.host, given.port, given.public).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
