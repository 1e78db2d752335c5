"""Command line: source files of one bundle to projected JSON.

    python -m weftline.cli --csv people.csv --ats ats.json --notes note.txt --config shape.json --output out.json
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from weftline.settings import SOURCES


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """One object if the bundle has one candidate, else an array in the order of first appearance; keys in order."""
    parser = argparse.ArgumentParser(prog="weftline")
    flags = dict(zip(("csv", "ats", "github", "notes"), SOURCES))
    for flag in flags:
        parser.add_argument(f"--{flag}", type=Path)
    parser.add_argument("--config", type=Path)
    parser.add_argument("--taxonomy", type=Path)
    parser.add_argument("--output", type=Path)
    parser.add_argument("--include-audit", action="store_true")
    args = parser.parse_args(argv)
    paths = {source: getattr(args, flag) for flag, source in flags.items() if getattr(args, flag)}
    for path in [*paths.values(), args.config, args.taxonomy]:
        if path is not None and not path.is_file():
            parser.error(f"{path} is not a file")

    from weftline.operators.skills import load_taxonomy
    from weftline.pipeline import run
    from weftline.sources.files import read_payloads

    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    payloads = read_payloads(spark, {s: f"file://{p.resolve()}" for s, p in paths.items()}, "bundle")
    taxonomy = load_taxonomy(spark, f"file://{args.taxonomy.resolve()}") if args.taxonomy else None
    try:
        config = json.loads(args.config.read_text(encoding="utf-8")) if args.config else None
        rows = run(payloads, config, taxonomy, args.include_audit).orderBy("root").collect()
    except ValueError as e:
        parser.error(str(e))
    if not rows:
        parser.error("no source gave a record")
    out = [json.loads(r.output) for r in rows]
    if args.include_audit:
        out = [{"output": o, "audit_log": [e.asDict() for e in r.audit_log]} for o, r in zip(out, rows)]
    text = json.dumps(out[0] if len(out) == 1 else out, indent=2, sort_keys=True, ensure_ascii=False)
    if args.output:
        args.output.write_text(text + "\n", encoding="utf-8")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])
    sys.exit(main())
