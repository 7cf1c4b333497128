"""resize and probe from the command line, without a Spark session."""

from __future__ import annotations

import argparse
import sys

from .errors import RowError, classify
from .functions.grammar import TOKENS
from .operators.transform import Config, probe, process


def main(argv: list[str] | None = None) -> int:
    """0; 1 if the image can't be worked off; 2 for a wrong call."""
    parser = argparse.ArgumentParser(prog="rasterloom")
    sub = parser.add_subparsers(dest="command", required=True)
    r = sub.add_parser("resize")
    for name in ("source", "target"):
        r.add_argument(name)
    for name in ("width", "height"):
        r.add_argument(name, type=int)
    r.add_argument("-q", type=int, dest="quality", choices=range(1, 101), metavar="1..100")
    r.add_argument("-f", dest="format", choices=sorted(TOKENS))
    p = sub.add_parser("probe")
    p.add_argument("source")
    try:
        args = parser.parse_args(argv)
        if args.command == "resize" and (min(args.width, args.height) < 0 or not (args.width or args.height)):
            parser.error("a width or a height is needed")
    except SystemExit as e:
        return int(e.code or 0)
    try:
        with open(args.source, "rb") as f:
            content = f.read()
        if args.command == "probe":
            found = probe(content)
            print(f"{found['format']} {found['width']}x{found['height']}")
            return 0
        by_name = TOKENS.get(args.target.rpartition(".")[2].lower())
        out = process(content, args.width, args.height, TOKENS[args.format] if args.format else by_name, args.quality, Config())
        with open(args.target, "wb") as f:
            f.write(out["data"])
        print(f"{args.target}: {out['format']} {out['width']}x{out['height']} {len(out['data'])} bytes", file=sys.stderr)
        return 0
    except Exception as e:
        wrong: RowError = classify(e)
        print(f"error: {wrong.message}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
