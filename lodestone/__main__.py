"""python -m lodestone FOLDER sql "SELECT ..." | tables | indexes | describe TABLE: the SQL front over a catalog's folder."""

from __future__ import annotations

import sys

from .engine import Engine
from .session import session


def main(args: list[str]) -> int:
    if len(args) < 2 or args[1] not in ("sql", "tables", "indexes", "describe") or (args[1] in ("sql", "describe") and len(args) < 3):
        print(__doc__)
        return 2
    engine = Engine(session(), args[0] if ":" in args[0] else f"file://{args[0]}")
    if args[1] == "sql":
        engine.sql(args[2]).show(1000, False)
    elif args[1] == "tables":
        engine.catalog.list().show(1000, False)
    elif args[1] == "describe":
        engine.catalog.describe(args[2]).show(1000, False)
    else:
        for table in engine.catalog.tables.values():
            for name, index in table.indexes.items():
                print(f"{name} on {table.name} ({', '.join(index['columns'])}) using {index['kind']}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
