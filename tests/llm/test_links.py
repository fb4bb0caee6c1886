"""All links between different sets against brute force."""

import pytest

from newsloom.llm import jaccard_join

from .conftest import prose
from .test_brute_force import near_copies
from .test_stage import shingles


@pytest.mark.parametrize(("num", "width"), [(90, 3), (80, 5)])
def test_all_links(spark, num, width):
    texts = near_copies(4)
    # a cluster large enough to be frequent, so that it is dealt over salts
    base = prose(55, 150).split()
    texts += [" ".join([*base[:k], f"y{k}", *base[k + 1 :]]) for k in range(0, 120, 2)]
    first = {}
    for k, x in enumerate(shingles(t, width) for t in texts):
        if x:
            first.setdefault(x, k)
    sets = sorted(first.items(), key=lambda x: x[1])
    wanted = {(i, j) for a, i in sets for b, j in sets if i < j and 100 * len(a & b) >= num * len(a | b)}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    got = [(r.doc_id, r.linked_id) for r in jaccard_join.all_links(df, num=num, width=width).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    run = jaccard_join.JaccardJoin(df, jaccard_join.Threshold(num, 100), width).run()
    assert run.links().distinct().count() < len(wanted)
