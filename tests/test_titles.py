"""The title join where many titles are equal, and its forms against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

import __spark_entry__
from newsloom.functions import udfs
from newsloom.operators import similarity
from pyspark.sql import functions as F

WORDS = [a + b for a in ("alpha", "gor", "the", "mint") for b in ("in", "ra", "zel", "ok", "ui")]


def made(n, seed=5):
    """Titles of few kinds, changed a little now and then, so that many are equal or alike."""
    rng = random.Random(seed)
    kinds, out = [rng.sample(WORDS, rng.randrange(5, 12)) for _ in range(12)], []
    for _ in range(n):
        t = list(rng.choice(kinds))
        for _ in range(rng.choice([0, 0, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        out.append(" ".join(t))
    return out


def score(a, b):
    x, y = set(a.split()), set(b.split())
    return 0.65 * SequenceMatcher(a=a, b=b).ratio() + 0.35 * len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def titles():
    return dict(enumerate(made(400), -900))  # ids below zero, in parts of their own


@pytest.fixture
def table(spark, tmp_path):
    def write(titles):
        spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in titles.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def test_best_earlier_against_every_pair(spark, table, titles):
    best = {}
    for i, a in titles.items():
        for j, b in titles.items():
            if j < i and (s := score(a, b)) >= 0.8:
                best[i] = max(best.get(i, (0, 0)), (round(s, 9), j))
    sf = table(titles)
    q = __spark_entry__.queries()
    assert {r.doc_id: (round(r.score, 9), r.best_id) for r in q["j2_duplicates"](spark, sf).collect()} == best
    assert sorted(r.doc_id for r in q["st4_sequential_duplicates"](spark, sf).collect()) == sorted(best)
    assert any(s < 1 for s, _ in best.values()) and len(best) > 300


def test_copies_are_one_node(spark):
    """Ten thousand copies meet no other copy: the join makes a row for each pair of different titles."""
    t = "one title that many of the pages bear"
    df = spark.range(10_000).select("id", F.when(F.col("id") == 7000, t + "s").otherwise(F.lit(t)).alias("title_norm"))
    kinds = similarity.classes(similarity.keyed(df))
    assert kinds.count() == 2 and similarity.similar_classes(kinds, kinds, also=similarity.later()).count() == 1
    got = similarity.best_earlier(df)
    assert got.count() == 9_999 and got.filter("score < 1").select("id", "best_id").collect() == [(7000, 6999)]
    assert got.filter("score = 1 AND best_id = id - 1").count() == 9_997
    assert similarity.with_earlier(df).count() == 9_999


def test_letters_bound_the_ratio(spark):
    texts = made(60, 9) + ["", "a" * 30, "é ü ñ 12", "no"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", udfs.letter_marks("t").alias("m"))
    marks = {r.t: r.m for r in df.collect()}
    for a in marks:
        for b in marks:
            apart = sum((x ^ y).bit_count() for x, y in zip(marks[a], marks[b], strict=True))
            assert not (a and b) or SequenceMatcher(a=a, b=b).ratio() <= 1 - apart / (len(a) + len(b)) + 1e-12


def test_same_tokens_in_any_order(spark, table, monkeypatch):
    """Token sets count, whatever the letters' order says; and classes are expanded in parts."""
    monkeypatch.setattr(similarity, "EXPANDED_ROWS", 2)
    monkeypatch.setattr(similarity, "HOT_ROWS", 3)
    long = [f"word{chr(97 + k)}x" for k in range(20)]
    titles = {1: "zebra apple mango fruit basket", 2: "basket fruit mango apple zebra", 3: None, 4: "zebra apple mango fruit", 5: "zebra zebra apple mango fruit basket", 6: " ".join(long), 7: " ".join(long[:0:-1]), 8: " ".join(long[2:])}
    titles |= {k: "zebra apple mango fruit basket" for k in range(9, 14)}
    long_enough = {k: set(t.split()) for k, t in titles.items() if t and len(t.split()) >= 5}
    wanted = sorted((i, j) for i, x in long_enough.items() for j, y in long_enough.items() if i > j and 100 * len(x & y) >= 95 * len(x | y))
    assert (2, 1) in wanted and (7, 6) in wanted and (8, 6) not in wanted
    assert sorted(tuple(r) for r in __spark_entry__.queries()["j2_candidates"](spark, table(titles)).select("new_id", "old_id").collect()) == wanted


def test_duplicates_against_every_pair(spark, titles):
    """New items that are recent ones, too, are not their own duplicates; ties go to the newest."""
    recent = {k: (t, (k * 7) % 50) for k, t in titles.items() if k % 2}
    new = {k: t for k, t in titles.items() if k % 3 == 0}
    best = {}
    for i, a in new.items():
        for j, (b, ts) in recent.items():
            if i != j and (s := score(a, b)) >= 0.8:
                best[i] = max(best.get(i, (0, 0, 0)), (round(s, 9), ts, j))
    got = similarity.duplicates(spark.createDataFrame(list(new.items()), "id bigint, title_norm string"), spark.createDataFrame([(k, *v) for k, v in recent.items()], "id bigint, title_norm string, published_ts bigint"))
    assert {r.id: (round(r.score, 9), r.best_id) for r in got.collect()} == {i: (s, j) for i, (s, _, j) in best.items()} and best


def test_every_new_item_has_its_own_window(spark, monkeypatch):
    """Items of equal titles are each asked for, at their own times, however old; both ends of a window are in it."""
    rng, old, new = random.Random(3), {}, {}
    for k, t in enumerate(made(240, 11)):
        (old if k % 3 else new)[f"i{k:03}"] = (t, rng.randrange(-400_000, 900_000))
    old |= {"at": (t, 5), "far": (t, 10_000_000)}
    new |= {"one": (t, 5 + 48 * 3600), "two": (t, 5), "late": (t, 10_000_000 + 48 * 3600 + 1), "i001": old["i001"]}
    best = {}
    for i, (x, at) in new.items():
        for j, (y, ts) in old.items():
            if i != j and at - 48 * 3600 <= ts <= at and (s := score(x, y)) >= 0.8:
                best[i] = max(best.get(i, (0, 0, "")), (round(s, 9), ts, j))
    asked, held = (spark.createDataFrame([(k, *v) for k, v in d.items()], "id string, title_norm string, published_ts bigint") for d in (new, old))
    for sure, hot in ((0.85, 2), (0.95, 5000)):
        monkeypatch.setattr(similarity, "SURE", sure)
        monkeypatch.setattr(similarity, "FREQUENT_ROWS", hot)
        got = similarity.windowed_duplicates(asked, held, 48)
        assert {r.id: (round(r.score, 9), r.best_id) for r in got.collect()} == {i: (s, j) for i, (s, _, j) in best.items()}
    assert {"one", "two"} <= set(best) and "late" not in best and any(s < 0.9 for s, *_ in best.values())


def test_windowed_query_asks_every_pending_event(spark, tmp_path):
    """Two clicks of one user have equal titles; months before the run they have matches, too."""
    rows = [(1, "2023-05-01 00:00:00", 12345, "view"), (2, "2023-05-01 10:00:00", 12345, "click"), (3, "2023-05-02 23:59:59", 12345, "click"), (4, "2023-05-04 00:00:00", 12345, "click"), (5, "2024-01-30 00:00:00", 12345, "purchase"), (6, "2024-01-30 05:00:00", 12345, "click")]
    spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = __spark_entry__.queries()["j2_windowed_duplicates"](spark, str(tmp_path)).collect()
    assert {r.id: r.best_id for r in got} == {"2": "1", "3": "1", "6": "5"}


@pytest.mark.parametrize(("hot", "cell"), [(3, 2), (40, 7), (10_000, 2048)])
def test_groups_against_every_pair(spark, monkeypatch, hot, cell):
    """Pairs of rare and of frequent tokens, some of both, in cells and in one piece; titles longer than a word of bits, and empty ends."""
    monkeypatch.setattr(similarity, "HOT_ROWS", hot)
    monkeypatch.setattr(similarity, "FREQUENT_ROWS", hot)
    monkeypatch.setattr(similarity, "CELL_ROWS", cell)
    rng = random.Random(hot)
    made_of = lambda n, kinds: [f"{rng.choice(kinds)} of the {rng.randrange(300)} alpha beta gamma delta u{rng.randrange(3)}" for _ in range(n)]
    long = [" ".join(f"w{rng.randrange(14)}é" for _ in range(30)) for _ in range(20)]
    new, old = made_of(70, ["click", "error", "signup"]) + made(40, 1) + long, made_of(70, ["view", "purchase"]) + made(40, 2) + long[:10] + [t[3:] for t in long]
    frames = [similarity.classes(similarity.keyed(spark.createDataFrame(list(enumerate(x)), "id bigint, title_norm string"))) for x in (new, old)]
    got = {(r.a, r.b): (r.bound, r.score) for r in similarity.similar_in_groups(*frames).join(frames[0].select(F.col("h").alias("a_h"), F.col("title_norm").alias("a")), "a_h").join(frames[1].select(F.col("h").alias("b_h"), F.col("title_norm").alias("b")), "b_h").collect()}
    wanted = {(x, y): s for x in set(new) for y in set(old) if (s := score(x, y)) >= 0.8}
    assert set(wanted) <= set(got) and len(wanted) > 60
    for (x, y), (bound, scored) in got.items():
        assert bound >= score(x, y) - 1e-12 and (scored is None or scored == bound == pytest.approx(score(x, y), abs=1e-12))


def test_groups_are_not_every_pair(spark, monkeypatch):
    """Titles of which only frequent tokens are the same are scored where their groups may be alike, not each by each."""
    def titles(kind):
        return spark.range(20_000).select("id", F.concat(F.lit(f"{kind} of the "), F.col("id") + 100_000, F.lit(" alpha beta gamma delta u"), F.col("id") % 20).alias("title_norm"))

    a, b = (similarity.classes(similarity.keyed(titles(kind))) for kind in ("click", "purchase"))
    found = similarity.similar_in_groups(a, b)
    assert found.count() == 20_000  # one number each; other numbers are too far, 20 million pairs of them of one source


def test_common_subsequence_is_a_bound():
    texts = made(60, 4) + ["", "a", "é ü", "x" * 64, "click of the 12345 alpha"]
    a = udfs._Titles({"a_h": [], "a_title": texts, "a_m": []}, "a")
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if len(texts[j]) <= 64]
    i, j = (list(x) for x in zip(*pairs, strict=True))
    for (x, y), n in zip(pairs, udfs._common(a.codes(), a.masks(), i, j), strict=True):
        s, t = texts[x], texts[y]
        assert n <= min(len(s), len(t)) and 2 * n >= SequenceMatcher(a=s, b=t).ratio() * (len(s) + len(t)) - 1e-9
