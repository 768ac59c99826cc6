"""Command line: select-dev, lock-thetas, evaluate, evaluate-folds, freeze, verify, prepare-train."""

from __future__ import annotations

import argparse
import json

from kohort.plans import workflows
from kohort.session import local_session
from kohort.sources import readers, writers


def numbered(values: list[str]) -> dict[int, str]:
    """``1=path`` arguments by number."""
    return {int(k): p for k, p in (v.split("=", 1) for v in values)}


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser("kohort")
    verbs = top.add_subparsers(dest="verb", required=True)
    for name, options in {
        "select-dev": ("gold", "scores", "out"), "lock-thetas": ("scans*", "out"), "evaluate": ("gold", "scores", "theta", "out"), "evaluate-folds": ("gold*", "scores*", "lock", "out"),
        "freeze": ("assets*", "out"), "verify": ("manifest",), "prepare-train": ("script", "splits", "out"),
    }.items():
        p = verbs.add_parser(name)
        for o in options:
            p.add_argument(f"--{o.rstrip('*')}", required=True, **({"nargs": "+"} if o.endswith("*") else {}))
        if name in ("select-dev", "evaluate", "evaluate-folds"):
            p.add_argument("--edge-rule", default="mutual", choices=("mutual", "either"))
        if name.startswith("evaluate"):
            p.add_argument("--backend", default="sparse", choices=("sparse", "dense"))
        if name == "prepare-train":
            p.add_argument("--interpreter", default="python")
            p.add_argument("args", nargs="*", help="of the script, after --")
    a = top.parse_args(argv)
    spark = lambda: local_session()
    gold = lambda path: readers.gold_csv(spark(), path).select("report_id", readers.F.col("event_id").alias("gold"))
    load = lambda p: json.load(open(p, encoding="utf-8"))  # noqa: E731, SIM115
    if a.verb == "select-dev":
        writers.write_json_atomic(a.out, workflows.select_dev(gold(a.gold), readers.scored_pairs(spark(), a.scores), rule=a.edge_rule))
    elif a.verb == "lock-thetas":
        writers.write_json_atomic(a.out, workflows.lock_thresholds({k: load(p) for k, p in numbered(a.scans).items()}))
    elif a.verb == "evaluate":
        row = workflows.evaluate_locked(gold(a.gold), readers.scored_pairs(spark(), a.scores), float(a.theta), a.edge_rule, a.backend).first()
        writers.write_json_atomic(a.out, row.asDict())
    elif a.verb == "evaluate-folds":
        g, s = numbered(a.gold), numbered(a.scores)
        rows, summary = workflows.evaluate_folds({k: gold(p) for k, p in g.items()}, {k: readers.scored_pairs(spark(), p) for k, p in s.items()}, load(a.lock), a.edge_rule, a.backend)
        writers.write_json_atomic(a.out, {"folds": [r.asDict() for r in rows.collect()], "summary": [r.asDict() for r in summary.collect()]})
    elif a.verb == "freeze":
        writers.freeze_manifest(dict(x.split("=", 1) for x in a.assets), a.out)
    elif a.verb == "verify":
        writers.verify_manifest(a.manifest)
    else:
        writers.write_json_atomic(a.out, workflows.training_handoff(a.script, a.splits, a.interpreter, a.args))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
