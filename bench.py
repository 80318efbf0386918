"""Time every check query once, results thrown away by the noop sink; prints one JSON line.

BENCH_SF_DIR names the input, BENCH_CPUS the local threads. Names on the command line pick queries.
"""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import queries  # noqa: E402
from opinionmill.session import local_session  # noqa: E402


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = {name: q for name, q in queries().items() if len(sys.argv) == 1 or name in sys.argv[1:]}
    spark = local_session("bench", cpus, **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8"})
    # The first query of a session pays for starting it.
    timed(queries()["kpis_facts"], spark, sf_dir)
    seconds = {name: timed(q, spark, sf_dir) for name, q in chosen.items()}
    factor = re.search(r"sf([\d.]+)/?$", sf_dir)
    print(json.dumps({
        "metric": "total wall time of all queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(factor[1]) if factor else None,
    }))


if __name__ == "__main__":
    main()
