"""python -m corpusmill: init, index, refresh, add, remember, sources, ask, profile."""

from __future__ import annotations

import argparse
import datetime as dt
from pathlib import Path

from corpusmill.engine import Engine, to_json
from corpusmill.sources import fetch, landing, registers, registry


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusmill")
    p.add_argument("--root", default="corpus", help="folder of the passage shards")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("index", help="chunk, embed and store the files of one source")
    x.add_argument("slug")
    x.add_argument("path")
    x.add_argument("--chunker", default="text")
    x.add_argument("--tier", type=int, default=3)
    x = sub.add_parser("sources", help="defined sources and what is built of them")
    x.add_argument("definitions")
    x = sub.add_parser("ask", help="the slate and prompt for a question, as JSON")
    x.add_argument("question")
    x.add_argument("-k", type=int)
    x.add_argument("--register", help="a register file of provisions not in force; what it covers is withheld")
    x = sub.add_parser("profile", help="show or set a field")
    x.add_argument("file")
    x.add_argument("assignment", nargs="?", help="key=value")
    x = sub.add_parser("init", help="build every defined source from landed files")
    x.add_argument("definitions")
    x.add_argument("landed", help="a folder with a folder of files for each source")
    x.add_argument("--shipped", help="the same, for sources of which nothing was landed")
    x = sub.add_parser("refresh", help="conditional refresh of named files, from a mirror folder")
    x.add_argument("items", help="name=url, separated by commas")
    x.add_argument("mirror", help="a folder of files named by their quoted urls")
    x.add_argument("table")
    x.add_argument("--force", action="store_true")
    x = sub.add_parser("add", help="add private documents")
    x.add_argument("path")
    x = sub.add_parser("remember", help="keep a note")
    x.add_argument("note")
    a = p.parse_args(argv)
    if a.command == "profile":
        if a.assignment:
            registry.set_value(a.file, *a.assignment.split("=", 1))
        print(to_json(registry.known(registry.load_profile(a.file))))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    engine = Engine(spark, a.root)
    if a.command == "index":
        binary = a.chunker in ("regulation", "pdf")
        files = landing.files(spark, a.path) if binary else landing.text_files(spark, a.path)
        built = engine.build(files, a.slug, a.chunker, tier=a.tier)
        print(to_json(built))
        return int(built["chunks"] == 0)
    if a.command == "init":
        landed = landing.by_source(spark, a.landed)
        reports = engine.init(registry.load(spark, a.definitions), landed, landing.by_source(spark, a.shipped) if a.shipped else None)
        for r in reports:
            print(to_json(r))
        return int(any(r["chunks"] == 0 for r in reports))
    if a.command == "refresh":
        items = spark.createDataFrame([tuple(x.split("=", 1)) for x in a.items.split(",")], "name string, url string")
        done = fetch.refresh(spark, items, a.table, fetch.folder(a.mirror), registers.accepts, dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"), force=a.force)
        for r in done.orderBy("name").collect():
            print(to_json(r.asDict()))
        return 0
    if a.command in ("add", "remember"):
        done = engine.add(landing.text_files(spark, a.path)) if a.command == "add" else engine.remember(a.note, dt.date.today().isoformat())
        print(to_json(done))
        return int(done["chunks"] == 0)
    if a.command == "sources":
        for r in engine.sources(registry.load(spark, a.definitions), dt.date.today().isoformat()).collect():
            print(to_json(r.asDict()))
        return 0
    if a.register:
        engine.register = registers.read_register(spark, Path(a.register).read_text())
    print(to_json(engine.ask(a.question, k=a.k)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
