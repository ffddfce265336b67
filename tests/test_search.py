"""Search by trigrams against a scan."""

import random

from weftline.operators import search as S
from weftline.operators.filters import FilterSpec, filter_repos

NAMES = ["Ada/Engine", "ada/engines", "bob/ngine", "ÄRGER/Straße", "x/y", "", "aaaa/aaa", "日本語/ライブラリ", "emoji/😀😀rocket😀", "a%_b/c\\d", "Ada/Engine"]


def test_every_pattern_equals_the_scan(spark):
    rng = random.Random(2)
    names = NAMES + ["".join(rng.choice("abA/") for _ in range(rng.randint(0, 9))) for _ in range(80)]
    core = spark.createDataFrame([(k, n, "extra") for k, n in enumerate(names)] + [(900, None, None)], "id long, full_name string, text string")
    links = spark.createDataFrame([(k, f"{n[:2]}-user") for k, n in enumerate(names[::3])] + [(3, None), (None, "ada")], "repo_id long, owner_login string")
    index = S.text_index(S.repo_texts(core, links))
    patterns = ["ENGINE", "ada", "ngin", "straße", "ärg", "a", "/", "日本", "本語/ラ", "😀😀r", "%_b", "\\", "aaaa", "aaaaa", "no such", "abab", "user", ""]
    for pattern in patterns:
        want = sorted(r.id for r in filter_repos(core, FilterSpec(search=pattern), links, None, None).select("id").collect())
        assert sorted(r.id for r in S.search_repos(core, index, pattern).select("id").collect()) == want, pattern


def test_only_the_rarest_grams_are_read_and_no_rows(spark):
    core = spark.createDataFrame([(k, f"team/common-{k}") for k in range(50)], "id long, full_name string")
    none = spark.createDataFrame([], "repo_id long, owner_login string")
    index = S.text_index(S.repo_texts(core, none))
    found = S.search(index, "common-41")
    assert [r.id for r in found.collect()] == [41]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (-41,n-4,com)" in plan  # the others are in all names
    empty = S.text_index(S.repo_texts(core.limit(0), none))
    assert S.search(empty, "common").count() == 0 and S.search(empty, "c").count() == 0
