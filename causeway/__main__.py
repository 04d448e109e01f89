"""python -m causeway COMMAND

queries                          the names of all queries
query NAME SF_DIR                a query's first rows
sql SF_DIR TEXT                  SQL over the tables and over every query, each a view of its name
report SF_DIR SESSION            the report of a session, as markdown
run SF_DIR SESSION FOLDER        the same as files, with the tables behind it
doctor SF_DIR                    what the installation and the data lack; exit code 1 if anything
"""

from __future__ import annotations

import datetime as dt
import sys

from causeway import catalog
from causeway.operators import quality
from causeway.plans import artefacts, daily, diagnostics, inputs, quality_queries, report
from causeway.session import session


def main(args: list[str]) -> int:
    match args:
        case ["queries"]:
            print("\n".join(sorted(catalog.queries())))
        case ["query", name, sf_dir]:
            catalog.queries()[name](session(), sf_dir).show(50, truncate=False)
        case ["sql", sf_dir, text]:
            spark = session()
            catalog.register_views(spark, sf_dir)
            spark.sql(text).show(50, truncate=False)
        case ["report", sf_dir, day]:
            spark = session()
            print(report.markdown(daily.run(inputs.px5(spark, sf_dir), inputs.macro(spark, sf_dir), inputs.bars(spark, sf_dir), day)))
        case ["run", sf_dir, day, folder]:
            spark = session()
            prices, macro, bars = inputs.px5(spark, sf_dir), inputs.macro(spark, sf_dir), inputs.bars(spark, sf_dir)
            built = daily.run(prices, macro, bars, day)
            at = artefacts.run_folder(folder, day, dt.datetime.now(dt.UTC).strftime("%H%M%SZ"))
            frames = {"prices": prices, "macro": macro, "issues": quality.validate_bars(bars), "manifest": quality_queries.health(spark, sf_dir)}
            artefacts.write_tables(spark, at, frames, csv=("issues", "manifest"))
            print("\n".join(artefacts.write_report(spark, at, built, day)))
        case ["doctor", sf_dir]:
            spark = session()
            rows = [*diagnostics.environment(), *(r.asDict() for r in diagnostics.data_checks(quality_queries.health(spark, sf_dir), inputs.px5(spark, sf_dir)).collect())]
            for r in rows:
                print(f"{r['status']:7} {r['check_name']}")
            return int(any(r["status"] != "ok" for r in rows))
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
