"""python -m scorelake QUERY --data FOLDER [--out FOLDER | --markdown]: runs a query by name; without a name lists them."""

from __future__ import annotations

import argparse

from .plans import registry
from .session import get_session
from .sources import files


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="scorelake")
    p.add_argument("query", nargs="?", choices=sorted(registry.QUERIES), metavar="QUERY")
    p.add_argument("--data", help="folder of Parquet tables")
    p.add_argument("--out", help="folder to write Parquet to")
    p.add_argument("--markdown", action="store_true", help="print a Markdown table (small results)")
    p.add_argument("--master", help="Spark master; by default what spark-submit says, or local[*]")
    a = p.parse_args(argv)
    if not a.query:
        print("\n".join(sorted(registry.QUERIES)))
        return
    if not a.data:
        p.error("--data is needed to run a query")
    df = registry.QUERIES[a.query](get_session(master=a.master or "local[*]"), a.data)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    elif a.markdown:
        print(files.markdown(df, a.query))
    else:
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()
