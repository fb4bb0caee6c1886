"""Editorial plans and drift checks on vectors like those of FIXTURES (R7, F10)."""

from pyspark.sql import functions as F

from newsloom.operators import evidence

FACTS = [
    ("F1", "world_design", "positive"), ("F2", "gameplay", "negative"), ("F3", "gameplay", "positive"), ("F4", "world_design", "positive"), ("F5", "story", "negative"),
    ("F6", "technical", "caution"), ("F7", "gameplay", "positive"), ("F8", "story", "negative"), ("F9", "world_design", "positive"), ("F10", "gameplay", "negative"),
]


def plans(spark, *articles, **kinds):
    rows = [(k, i, "", topic, sentiment, "x" * (10 + at), 0) for k, facts in enumerate(articles) for at, (i, topic, sentiment) in enumerate(facts)]
    found = spark.createDataFrame(rows, "game int, fact_id string, site_name string, topic string, sentiment string, text_fa string, specificity int")
    out = {}
    for r in evidence.editorial_plan(found, ["game"], **kinds).orderBy("game", "part", "place").collect():
        out.setdefault(r.game, {}).setdefault(r.part, []).append(r.fact_id)
    return out


def test_plan(spark):
    few = FACTS[:5]  # friction has one fact
    got = plans(spark, FACTS, few)
    assert set(got) == {0}
    p = got[0]
    told = p["opening_positive"] + p["opening_negative"] + p["world_gameplay"] + p["friction"]
    assert len(told) == len(set(told)) == 8 and len(p["friction"]) == 3
    assert p["audience"] == [p["world_gameplay"][0], p["friction"][0]]
    assert p["conclusion"] == p["opening_positive"] + p["opening_negative"]


def test_long_plan(spark):
    more = [*FACTS, ("G1", "audio", "positive"), ("G2", "visuals", "negative"), ("G3", "value", "positive")]
    got = plans(spark, more, FACTS[1:], plan=evidence.LONG_PLAN, least=evidence.LONG_LEAST)
    assert set(got) == {0}
    assert [len(got[0][k]) for k in ("world_gameplay", "friction", "audience", "conclusion")] == [5, 5, 2, 2]


def test_drift(spark):
    base = "برای بازیکنی که از آزمون‌وخطا لذت می‌برد مناسب است"
    rows = [
        (base, base, ""), (base, base + " به گفته‌ی IGN.", ""), (base, base + " و 95", ""), (base, "برای بازیکنی", ""),
        (base, base + " با کاوش", "این مقاله از کاوش می‌گوید"), (base, base + " با صداگذاری", "این مقاله از کاوش می‌گوید"), (base, base + " واژه" * 20, ""),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, old string, new string, article string")
    told = lambda **kw: [r.p for r in df.select("id", evidence.drift_problem(F.col("old"), F.col("new"), site_names=["IGN"], article=F.col("article"), **kw).alias("p")).orderBy("id").collect()]
    assert told() == [None, "site", "number", "short", None, "detail", "long"]
    assert told(low=0.45, factor=2.5, extra=15, details=False) == [None, "site", "number", "short", None, None, None]
