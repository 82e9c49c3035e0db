"""python -m gistmill QUERY SF_DIR [OUT]: run a named query, show its rows or write them as Parquet."""

from __future__ import annotations

import sys

from .plans import QUERIES
from .session import session


def main(args: list[str]) -> None:
    if len(args) < 2 or args[0] not in QUERIES:
        sys.exit(f"{__doc__}\n\n" + "\n".join(sorted(QUERIES)))
    found = QUERIES[args[0]](session(), args[1])
    if len(args) > 2:
        found.write.mode("overwrite").parquet(args[2])
    else:
        found.show(50, truncate=80)


if __name__ == "__main__":
    main(sys.argv[1:])
