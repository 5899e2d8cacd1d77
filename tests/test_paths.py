"""Join paths against all sets of tables."""

from itertools import combinations

from askweave.plans.pipeline_queries import QUERIES
from askweave.sources.catalog import STAR_FOREIGN, STAR_PRIMARY


def _connected(own):
    seen = {own[0]}
    while more := {y for a, _, b, _ in STAR_FOREIGN for x, y in ((a, b), (b, a)) if x in seen and y in own} - seen:
        seen |= more
    return len(seen) == len(own)


def test_paths_are_all_connected_sets_up_to_five(spark):
    tables = {*STAR_PRIMARY, *(f[0] for f in STAR_FOREIGN)}
    want = {",".join(sorted(own)) for n in range(1, 6) for own in combinations(tables, n) if _connected(own)}
    assert {r["tables"] for r in QUERIES["join_paths"](spark, "/root/testdata/sf0.001").collect()} == want and any(t.count(",") == 4 for t in want)
