"""python -m lakeloom NAME --storage URI QUERY: runs one SQL text and prints its rows."""

from __future__ import annotations

import argparse

from .sdk import Lake


def main() -> None:
    parser = argparse.ArgumentParser(prog="lakeloom", description=__doc__)
    parser.add_argument("name")
    parser.add_argument("query")
    parser.add_argument("--storage")
    parser.add_argument("--rows", type=int, default=50)
    args = parser.parse_args()
    with Lake(args.name, args.storage) as lake:
        lake.sql_df(args.query).show(args.rows, truncate=False)


if __name__ == "__main__":
    main()
