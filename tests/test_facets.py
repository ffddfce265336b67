"""Bitmap facets against filtering and counting."""

import random
from collections import Counter

from weftline.operators import facets


def test_any_choice_is_counted_as_by_filtering(spark):
    rng = random.Random(6)
    rows = [(k * 1_000_003, rng.choice(["Go", "C", None]), rng.choice(["MIT", None]), rng.sample(["x", "y", "z"], rng.randint(0, 3)) or None, rng.choice(["User", "Bot", None]), rng.choice([2001, 2002, None]), rng.choice([True, False, None]), rng.random() < 0.3) for k in range(400)]
    schema = "id long, primary_language string, license string, topics array<string>, owner_type string, year int, archived boolean, is_fork boolean"
    with_releases, with_deps = {r[0] for r in rows if rng.random() < 0.5}, {r[0] for r in rows if rng.random() < 0.2}
    child = lambda ids: spark.createDataFrame([(i,) for i in sorted(ids) for _ in range(2)], "repo_id long")
    index = facets.facet_index(spark.createDataFrame(rows, schema), child(with_releases), child(with_deps)).persist()

    def values(r):
        flag = lambda b: "true" if b else "false"
        out = [("language", r[1] or "—"), ("license", r[2]), ("owner_type", r[4]), ("year", str(r[5] or "none")), ("archived", flag(r[6])), ("fork", flag(r[7])), ("releases", flag(r[0] in with_releases)), ("dependencies", flag(r[0] in with_deps))]
        return {(f, v) for f, v in [*out, *(("topic", t) for t in r[3] or [])] if v is not None}

    held = [values(r) for r in rows]
    for settings in ({}, {"language": ["Go"]}, {"language": ["Go", "—"], "fork": ["false"], "topic": ["x", "y"]}, {"year": ["2002", "none"], "releases": ["true"], "owner_type": ["User"]}, {"license": ["GPL"]}):
        left = [h for h in held if all(any((f, v) in h for v in vs) for f, vs in settings.items())]
        assert facets.count_chosen(index, settings).head().n == len(left)
        assert {(r.facet, r.value): r.n for r in facets.facets_of_chosen(index, settings).collect()} == Counter(x for h in left for x in h)
    assert facets.count_chosen(facets.facet_index(spark.createDataFrame([], schema), child([]), child([])), {}).head().n == 0
