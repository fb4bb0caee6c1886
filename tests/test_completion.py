"""Generation with completions that answer well, badly, or not at all."""

import json


from newsloom.plans import completion

BODY = "".join(f"<p>{'این یک جمله‌ی کامل است ' * 30}.</p>" for _ in range(4))


def test_news_articles(spark):
    stories = spark.createDataFrame([("good", "Elden Ring DLC trailer", "s", "IGN", "https://x.com/1", "text"), ("late", "t", "s", "n", "", "p"), ("never", "t", "s", "n", "", "p")], "key string, title string, snippet string, source_name string, source_url string, page_text string")
    reply = json.dumps({"title_fa": " <b>عنوان</b> ", "meta_title_fa": "م" * 90, "meta_description_fa": "توضیح", "focus_keyword_fa": "کلید", "content_html_fa": BODY.replace("<p>", "<p>https://x.com/1 ", 1), "content_type": "Games", "entity_tags": ["Elden Ring", "elden ring", "Game"]})

    def complete(prompt):
        if "Elden Ring" in prompt:
            return "Here: " + reply
        if "rejected" in prompt and "Title: t" in prompt:
            return reply
        return '{"title_fa": "x"}'

    good, left = completion.news_articles(stories, complete)
    rows = {r.key: r for r in good.collect()}
    assert set(rows) == {"good", "late", "never"} and rows["good"].attempt == 0 and rows["late"].attempt == 1
    r = rows["good"]
    assert (r.title_fa, len(r.meta_title_fa), r.content_type, r.entity_tags) == ("عنوان", 70, "gaming", ["Elden Ring"]) and "https://x.com/1" not in r.content_html_fa
    good, left = completion.news_articles(stories, None)
    assert good.count() == 0 and {r.problem for r in left.collect()} == {"no JSON object"}


def test_selected_points(spark):
    sentence = "The open world is the best part of this adventure by far."
    other = "The story never finds a reason to care about its people."
    pages = spark.createDataFrame([("k", "G", "PC", "IGN", "", "", f"{sentence} {other}")], "key string, game string, platform string, site_name string, title string, description string, text string")
    reply = json.dumps({"positives": [{"point_fa": "جهان باز خوب است", "evidence_id": "E001"}, {"point_fa": "x", "evidence_id": "E099"}], "negatives": [{"point_fa": "داستان ضعیف است", "evidence_id": "E001"}, {"point_fa": "داستان ضعیف است", "evidence_id": "E002"}], "technical_notes": None, "verdict": None})

    def complete(prompt):
        assert f"E001: {sentence}" in prompt and f"E002: {other}" in prompt
        return reply

    got = sorted((r.section, r.evidence_id, r.evidence_en) for r in completion.analysed(pages, complete).collect())
    assert got == [("negatives", "E002", other), ("positives", "E001", sentence)]
    assert completion.analysed(pages, None).count() == 0


def test_revised_sections(spark):
    bounds = {"friction": (4, 20), "audience": (2, 20)}
    sections = spark.createDataFrame([(1, "friction", "نبرد سخت و طولانی و دشوار است"), (1, "audience", "x"), (2, "friction", ""), (2, "audience", "برای همه مناسب است")], "article int, part string, text_fa string")
    facts = spark.createDataFrame([(1, "audience", 1, "F1", "positive", "برای بازیکن صبور است؟"), (2, "friction", 1, "F2", "negative", "باگ دارد")], "article int, part string, place int, fact_id string, sentiment string, text_fa string")
    complete = lambda prompt: json.dumps({"text_fa": "کنترل بازی همیشه دقیق نیست"}) if "friction" in prompt and "empty" in prompt and "F2 (negative): باگ دارد" in prompt else "no"
    got = {(r.article, r.part): (r.method, r.text_fa) for r in completion.revised_sections(sections, facts, ["article"], bounds, ["IGN"], complete).collect()}
    assert got == {(1, "friction"): ("kept", "نبرد سخت و طولانی و دشوار است"), (2, "audience"): ("kept", "برای همه مناسب است"), (1, "audience"): ("fallback", "برای بازیکن صبور است."), (2, "friction"): ("revised", "کنترل بازی همیشه دقیق نیست")}


def test_rewrites_that_stray_are_left(spark):
    rows = spark.createDataFrame([("a", "این بازی 10 ساعت طول می‌کشد", "p1"), ("b", "این بازی 10 ساعت طول می‌کشد", "p2"), ("c", "متن", "p3")], "key string, text_fa string, prompt string")
    complete = lambda p: {"p1": '{"text_fa": "بازی حدود 10 ساعت زمان می‌برد"}', "p2": '{"text_fa": "بازی حدود 12 ساعت زمان می‌برد"}'}[p]
    got = {r.key: r.rewritten for r in completion.rewritten(rows, complete, ["IGN"]).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_fallback_article(spark):
    facts = spark.createDataFrame([(1, 1, "world_design", "positive", "جهان زنده است"), (1, 2, "story", "negative", "داستان ضعیف است."), (2, 1, "general", "caution", "کوتاه است")], "article int, rank int, topic string, sentiment string, text_fa string")
    got = {(r.article, r.part): r.text_fa for r in completion.fallback_article(facts, ["article"]).collect()}
    assert got[1, "friction"] == "داستان ضعیف است." and got[1, "conclusion"] == "جهان زنده است. داستان ضعیف است." and (2, "audience") not in got and got[2, "friction"] == "کوتاه است."


def test_game_intro(spark):
    rows = spark.createDataFrame([("k", "بازی", "PC", None, "d")], "key string, game string, platform string, release_date string, description string")
    assert [tuple(r) for r in completion.game_intro(rows, None).collect()] == [("k", "«بازی» برای PC عرضه شد.", True)]
