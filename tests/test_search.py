"""The search of posts by words against a walk over all posts, where words and titles are few and repeated."""

import random

from newsloom.operators import posts, similarity
from pyspark.sql import functions as F


def test_search_against_every_post(spark):
    rng = random.Random(4)
    words = ["large", "ring", "blue", "gear", "plate", "brass", "steel", "promo"]
    items = [(k, " ".join(rng.sample(words, rng.randrange(0, 5)))) for k in range(60)] + [(60, "missing ring"), (61, None), (62, "the of")]
    held = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 7))).upper(), rng.randrange(5)) for k in range(300)] + [(300, None, 9)]
    wanted = set()
    for i, title in items:
        asked = set((title or "").split()) - {"the", "of"}
        hits = [p for p in sorted(held, key=lambda p: (-p[2], p[0])) if asked and asked <= set((p[1] or "").lower().split())]
        wanted |= {(i, p[0], at) for at, p in enumerate(hits[:4], 1)}
    got = posts.found_by_words(spark.createDataFrame(items, "id int, title string"), spark.createDataFrame(held, "post_id int, title string, published_ts int"), 4, 4)
    assert {(r.id, r.post_id, r.place) for r in got.collect()} == wanted and wanted


def test_copies_are_searched_once(spark):
    """Thirty thousand items of one title, as many posts: before, nine hundred million rows met at each word."""
    title = F.lit("one large brass ring with gears")
    items, held = spark.range(30_000).select("id", title.alias("title")), spark.range(30_000).select(F.col("id").alias("post_id"), title.alias("title"), F.col("id").alias("published_ts"))
    assert posts.found_by_words(items, held, 4).groupBy("place").agg(F.count("*"), F.min("post_id"), F.max("post_id")).orderBy("place").collect() == [(k, 30_000, 30_000 - k, 30_000 - k) for k in range(1, 11)]
    best = posts.similar_posts(items, held, similarity.THRESHOLD)
    assert best.filter("score = 1 AND post_id = 29999").count() == 30_000
