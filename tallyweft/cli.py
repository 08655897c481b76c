"""Command line: config, data, train, compare, federated, evaluate, explain."""

from __future__ import annotations

import argparse
import json
import sys

from tallyweft import config, manifest
from tallyweft.sources import registry


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tallyweft").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyweft")
    p.add_argument("--config")
    p.add_argument("--profile", choices=sorted(config.PROFILES))
    p.add_argument("--set", action="append", default=[], metavar="SECTION.KEY=VALUE")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("config-show", "config-hash", "train", "compare", "federated", "evaluate"):
        sub.add_parser(name)
    for name in ("fetch", "prepare"):
        sub.add_parser(name).add_argument("dataset")
    run = sub.add_parser("explain").add_subparsers(dest="what", required=True).add_parser("run")
    run.add_argument("account")
    return p


def _overrides(pairs: list[str]) -> dict:
    out: dict = {}
    for pair in pairs:
        path, _, text = pair.partition("=")
        *sections, key = path.split(".")
        at = out
        for s in sections:
            at = at.setdefault(s, {})
        try:
            at[key] = json.loads(text)
        except ValueError:
            at[key] = text
    return out


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    s = config.load(a.config, a.profile, _overrides(a.set))
    if a.command == "config-show":
        print(json.dumps(s.to_dict(), indent=2, sort_keys=True))
        return 0
    if a.command == "config-hash":
        print(s.hash())
        return 0
    if a.command == "fetch":
        folder = f"{s.raw_dir}/{a.dataset}"
        states = registry.on_disk(registry.expected(a.dataset), folder)
        ready = "absent" not in states.values()
        print(json.dumps(states, indent=2) if ready else registry.how_to_get(a.dataset, folder))
        return 0 if ready else 1
    from tallyweft.plans import flows
    from tallyweft.sources.adapters import adapter

    name = getattr(a, "dataset", s.dataset)
    data = adapter(name, _session()).run(f"{s.raw_dir}/{name}")
    manifest.record("runs", name, s.hash(), s.seed)
    if a.command == "prepare":
        flows.prepare(data, s, s.processed_dir)
    elif a.command == "train":
        trained = flows.train(data, s)
        flows.write_reports(trained, f"reports/{name}-{s.hash()}")
        print(json.dumps(trained.metrics, indent=2, default=str))
    elif a.command == "explain":
        print(json.dumps(flows.explain_account(data, s, flows.train(data, s), a.account), indent=2, default=str))
    elif a.command == "compare":
        flows.compare(data, {n: config.load(a.config, n, _overrides(a.set)) for n in ("baseline", "neighbour_mean")}).show(truncate=False)
    elif a.command == "federated":
        flows.three_conditions(data, s).show(truncate=False)
    else:
        print(flows.evaluation_report(data, s, flows.train(data, s)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
