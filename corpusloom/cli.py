"""Command line: list queries, run one into a table, explain its plan, code texts and decode them.

Options are checked before any work starts: each at most once, none that the mode
doesn't know, inputs there, outputs not.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass, field

MODES = {"list": set(), "run": {"tables", "out"}, "explain": {"tables"}, "encode": {"tables", "out"}, "decode": {"coded", "out"}}
OPTIONAL = {"run": {"partition"}, "encode": set(), "decode": set(), "explain": set(), "list": set()}
NAMED = {"run", "explain"}


@dataclass
class Options:
    mode: str
    name: str | None = None
    values: dict[str, str] = field(default_factory=dict)


def parse(argv: list[str]) -> Options:
    """Fails on an unknown mode or option, an option without a value or given twice, and on what is missing."""
    if not argv or argv[0] not in MODES:
        raise ValueError(f"the mode is one of {', '.join(MODES)}")
    out = Options(argv[0])
    rest = list(argv[1:])
    while rest:
        a = rest.pop(0)
        if not a.startswith("--"):
            if out.name is not None or out.mode not in NAMED:
                raise ValueError(f"{a} isn't expected")
            out.name = a
            continue
        key = a[2:]
        if key not in MODES[out.mode] | OPTIONAL[out.mode]:
            raise ValueError(f"{out.mode} has no option {a}")
        if key in out.values:
            raise ValueError(f"{a} is given twice")
        if not rest or rest[0].startswith("--"):
            raise ValueError(f"{a} needs a value")
        out.values[key] = rest.pop(0)
    missing = MODES[out.mode] - set(out.values)
    if missing or (out.mode in NAMED and out.name is None):
        raise ValueError(f"{out.mode} needs {', '.join(sorted(f'--{m}' for m in missing) or ['a query'])}")
    return out


def validate(o: Options) -> None:
    """Local inputs must be there and local outputs not; other paths are left to Spark."""
    for key in ("tables", "coded"):
        p = o.values.get(key)
        if p and "://" not in p and not os.path.isdir(p):
            raise FileNotFoundError(p)
    out = o.values.get("out")
    if out and "://" not in out and os.path.exists(out):
        raise FileExistsError(out)
    if out and out in (o.values.get("tables"), o.values.get("coded")):
        raise ValueError("input and output are the same")


def main(argv: list[str] | None = None) -> int:
    from corpusloom.plans import registry

    o = parse(sys.argv[1:] if argv is None else argv)
    validate(o)
    registry.load()
    if o.mode == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if o.name is not None and o.name not in registry.QUERIES:
        raise ValueError(f"there is no query {o.name}")
    from corpusloom.operators.codec import decode_documents, encode_documents
    from corpusloom.session import build_session, ship
    from corpusloom.sources.sinks import store
    from corpusloom.sources.tables import table

    spark = ship(build_session())
    v = o.values
    if o.mode == "explain":
        registry.QUERIES[o.name](spark, v["tables"]).explain("formatted")
    elif o.mode == "run":
        store(registry.QUERIES[o.name](spark, v["tables"]), v["out"], [v["partition"]] if "partition" in v else None)
    elif o.mode == "encode":
        store(encode_documents(table(spark, v["tables"], "documents")), v["out"])
    else:
        store(decode_documents(spark.read.parquet(v["coded"])), v["out"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
