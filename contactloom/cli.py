"""Command line: run, chambers, export, stats, recent, init, config, test."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import logging.handlers

from pyspark.sql import functions as F

from contactloom import config
from contactloom.operators import directory, extract, fetch, report, resolve
from contactloom.session import session
from contactloom.sources import pages, seeds
from contactloom.sources.leads import Leads, export_csv, save_results

log = logging.getLogger("contactloom")


def log_to(settings: config.LogSettings) -> None:
    """To the terminal, and to a rotating file and a file of errors where a path is set."""
    log.setLevel({"TRACE": "DEBUG"}.get(settings.level, settings.level))
    for h in list(log.handlers):
        log.removeHandler(h)
    sinks: list[logging.Handler] = [logging.StreamHandler()]
    if settings.path:
        sinks.append(logging.handlers.RotatingFileHandler(settings.path, maxBytes=10_000_000, backupCount=5))
        sinks.append(logging.handlers.RotatingFileHandler(f"{settings.path}.errors", maxBytes=10_000_000, backupCount=5))
        sinks[-1].setLevel("ERROR")
    for s in sinks:
        s.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(s)


def run_sites(spark, settings, leads: Leads, fetched=None):
    """Seed list to stored leads; one row with pages processed, saved and failed."""
    urls = seeds.seed_urls(spark, settings.seeds_path).select("url") if fetched is None else None
    got = fetched if fetched is not None else pages.fetch(urls, settings.crawler, robots=pages.robots_rules(urls.select(pages.registered_domain(F.col("url")).alias("domain"))))
    got = got.persist()
    records = extract.worth_keeping(extract.extract(fetch.successful(got).select(F.col("final_url").alias("url"), "html"), settings.profile))
    leads.create()
    saved = leads.append(records)
    n, total = saved.count(), got.count()
    got.unpersist()
    return {"processed": total, "saved": n, "failed": total - n}


def run_chambers(spark, settings, leads: Leads, urls=None, path=None, fetched=None):
    """Directories to stored leads, without repeats."""
    chambers = seeds.chamber_source(spark, urls, path or settings.chambers_path).select(F.col("url").alias("chamber_url"))
    got = fetched if fetched is not None else pages.fetch(chambers.select(F.col("chamber_url").alias("url")), settings.crawler)
    listed = directory.parse_directories(chambers, fetch.successful(got).select("url", "html"))
    ordered = listed.withColumn("seq", F.xxhash64("chamber_url", "dir_no", "depth", "pos"))
    unique = resolve.dedupe_by_hash(resolve.identified(resolve.normalized(ordered, chamber_name=F.lit(None).cast("string"), chamber_url=F.col("chamber_url"))))
    leads.create()
    return save_results(leads, resolve.upsert(leads.read(), unique))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="contactloom")
    parser.add_argument("--env-file", default=".env")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("run").add_argument("--input")
    c = commands.add_parser("chambers")
    c.add_argument("--input")
    c.add_argument("urls", nargs="*")
    e = commands.add_parser("export")
    e.add_argument("output")
    e.add_argument("--limit", type=int, default=0)
    for name in ("stats", "init", "config"):
        commands.add_parser(name)
    commands.add_parser("recent").add_argument("-n", type=int, default=5)
    commands.add_parser("test").add_argument("url")
    a = parser.parse_args(argv)
    settings = config.load(env_file=a.env_file)
    log_to(settings.log)
    if a.command == "config":
        print(json.dumps(dataclasses.asdict(settings), indent=2))
        return 0
    spark = session()
    leads = Leads(spark, settings.store.leads_path)
    if a.command == "test":
        got = pages.fetch(spark.createDataFrame([(a.url,)], "url STRING"), settings.crawler)
        extract.extract(fetch.successful(got), settings.profile).drop("html").show(truncate=False, vertical=True)
        return 0
    leads.create()
    if a.command == "run":
        print(json.dumps(run_sites(spark, dataclasses.replace(settings, seeds_path=a.input or settings.seeds_path), leads)))
    elif a.command == "chambers":
        print(json.dumps(run_chambers(spark, settings, leads, a.urls, a.input)))
    elif a.command == "export":
        print("exported" if export_csv(leads.read(), a.output, a.limit or None, single_file=True) else "no leads to export")
    elif a.command == "stats":
        report.completeness(leads.read()).show(vertical=True)
        report.recent(leads.read()).show(truncate=False)
    elif a.command == "recent":
        report.recent(leads.read(), a.n).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
