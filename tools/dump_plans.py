"""Write the formatted physical plan of every registered query (or the given
keys) into a fresh scratch folder, one file per query.

    python tools/dump_plans.py [sf_dir] [key ...]

Set STATIC_BROADCAST=0 to see the shuffle-join plans a large cluster gets
(the test files are small enough that Spark broadcasts most joins).
"""

from __future__ import annotations

import contextlib
import io
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stagelight.plans.catalog import QUERIES  # noqa: E402
from stagelight.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(QUERIES)
    extra = {}
    if os.environ.get("STATIC_BROADCAST") == "0":
        extra["spark.sql.autoBroadcastJoinThreshold"] = "-1"
    spark = build_session("local[4]", app_name="stagelight-plans", shuffle_partitions=8, extra=extra)
    spark.sparkContext.setLogLevel("ERROR")
    out = tempfile.mkdtemp(prefix="stagelight-plans-", dir="/tmp")
    for key in keys:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            QUERIES[key](spark, sf_dir).explain(mode="formatted")
        with open(os.path.join(out, f"{key}.txt"), "w") as fh:
            fh.write(buf.getvalue())
    print(out)


if __name__ == "__main__":
    main()
