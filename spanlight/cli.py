"""spanlight on the command line: ingest, search, context, trace, verify, forget, ledger, errors, indexes, ask, eval, demo, doctor, serve."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from spanlight import config, errors, providers, server
from spanlight.plans import package
from spanlight.sources import folder
from spanlight.workspace import Workspace, to_text

DEMO = {
    "stoves.md": "# Stoves\n\nThe alcohol stove boils half a litre in eight minutes.\n\n## Fuel\n\nCarry 30 ml of fuel for each boil.\n",
    "shelter.md": "# Shelter\n\nThe tarp weighs 310 grams. Pitch it low in wind.\n",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanlight", description=__doc__)
    p.add_argument("--settings", help="JSON file of settings")
    p.add_argument("--store")
    p.add_argument("--index-name", default="default")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: tuple, **kw: object) -> argparse.ArgumentParser:
        v = sub.add_parser(name, **kw)
        for flags, options in args:
            v.add_argument(*flags, **options)
        return v

    verb("ingest", (("folder",), {}), (("--ignore",), {"help": "file of ignore rules"}))
    verb("search", (("query",), {}), (("--limit",), {"type": int}))
    verb("context", (("query",), {}), (("--budget",), {}), (("--ordering",), {}), (("--root",), {}), (("--why-not",), {"action": "store_true"}), (("--render",), {"action": "store_true"}))
    verb("trace", (("quotation",), {}))
    verb("verify", (("package",), {}), (("answer",), {}))
    verb("ask", (("query",), {}), (("--model",), {"required": True}), (("--url",), {"default": "http://localhost:11434"}), (("--budget",), {}))
    verb("forget", (("paths",), {"nargs": "+"}))
    verb("ledger", (("--since",), {}), (("--forget",), {"action": "store_true", "help": "empty the ledger"}))
    verb("errors")
    verb("indexes")
    verb("eval", (("cases",), {}), (("--tier",), {}), (("--split",), {}))
    verb("demo")
    verb("doctor", (("--root",), {}))
    verb("serve")
    return p


def session() -> SparkSession:
    s = SparkSession.builder.appName("spanlight").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def run(argv: list[str]) -> int:
    a = parser().parse_args(argv)
    flags = {"store": a.store, "index": f"{a.store}/index" if a.store else None, "ordering": getattr(a, "ordering", None)}
    settings = config.load(a.settings, flags=flags)
    if a.verb == "errors":
        for e in errors.CATALOGUE:
            print(f"{e.kind}\t{e.exit_code}\t{e.outcome}\t{'retry' if e.retryable else 'no retry'}")
        return 0
    if a.verb == "indexes":
        print("\n".join(sorted(settings.named_indexes())))
        return 0
    if a.verb == "demo":
        return demo()
    if a.verb == "eval":
        from spanlight.plans.evaluation import evaluated

        table, broken = evaluated(session(), a.cases, a.tier, a.split)
        print(json.dumps(table, indent=2), *broken, sep="\n")
        return int(bool(broken))
    ws = Workspace(session(), settings, a.index_name)
    if a.verb == "ingest":
        rules = folder.IgnoreRules.parse(Path(a.ignore).read_text(encoding="utf-8")) if a.ignore else folder.IgnoreRules()
        counts = {r["status"]: r["count"] for r in ws.ingest(a.folder, rules).groupBy("status").count().collect()}
        print(json.dumps(counts, sort_keys=True))
        return int(bool(counts.get("failed")))
    if a.verb == "search":
        rows, cut = ws.search(a.query, a.limit)
        for r in rows:
            print(f"{r['rank']:>3} {r['score']:.6f} {r['source_path']}[{r['start']}:{r['end']}]{' (unconfirmed)' if r['unconfirmed'] else ''} {r['text']}")
        if cut:
            print("the candidate cap was reached", file=sys.stderr)
        return int(not rows)
    if a.verb == "context":
        made = ws.context(a.query, a.budget, root=a.root)
        print(package.render(made) if a.render else to_text(made))
        if a.why_not:
            print("\n".join(f"{o['rule']}: {o['reason']}" for o in made["omissions"]), file=sys.stderr)
        if not made["items"]:
            for lead in ws.leads(made):
                print(f"not confirmed: {lead['source_path']}[{lead['start']}:{lead['end']}] {lead['text']}", file=sys.stderr)
        return int(not made["items"])
    if a.verb == "ask":
        model = providers.GenerateProvider(a.model, a.url)
        made = ws.context(a.query, a.budget, "answering")
        report = ws.verify(made, model.generate(package.render(made)))
        print(to_text(report))
        return int(not report["clean"])
    if a.verb == "trace":
        found = ws.trace(a.quotation)
        for r in found:
            print(f"{r['source_path']}:{r['line']}{' (' + r['section'] + ')' if r['section'] else ''} [{r['start']}:{r['end']}]")
        return int(not found)
    if a.verb == "verify":
        report = ws.verify(package.read_back(Path(a.package).read_text(encoding="utf-8")), Path(a.answer).read_text(encoding="utf-8"))
        print(to_text(report))
        return int(not report["clean"])
    if a.verb == "forget":
        n = ws.forget(a.paths)
        print(n)
        return int(not n)
    if a.verb == "ledger" and a.forget:
        print(ws.forget_ledger())
        return 0
    if a.verb == "ledger":
        print(json.dumps(ws.usage(a.since)))
        return 0
    if a.verb == "doctor":
        print(json.dumps(ws.doctor(a.root)))
        return 0
    server.serve(ws, sys.stdin, sys.stdout)
    return 0


def demo() -> int:
    """A corpus of two notes, a question, a package and a checked answer."""
    with tempfile.TemporaryDirectory() as d:
        root = Path(d, "notes")
        root.mkdir()
        for name, text in DEMO.items():
            (root / name).write_text(text, encoding="utf-8")
        ws = Workspace(session(), config.load(env={}, flags={"store": f"{d}/store", "index": f"{d}/index"}))
        ws.ingest(str(root))
        made = ws.context("alcohol stove boils", "characters:200")
        print(package.render(made))
        report = ws.verify(made, json.dumps({"claims": [{"text": "It takes eight minutes.", "citations": ["half a litre in eight minutes"]}]}))
        print(to_text(report["counts"]))
        return int(not report["clean"])


def main() -> int:
    try:
        return run(sys.argv[1:])
    except errors.SpanlightError as e:
        print(f"{e.kind}: {e}", file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
