"""Character references without a semicolon, as the reference's HTML parser resolves them."""

import html

from newsloom.functions import html as html_functions
from pyspark.sql import functions as F


def test_sanitized_references(spark):
    texts = ["a &&amp", "x &copy y", "&ampp", "&amp;amp", "&notit;"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r.s: r.x for r in df.select("s", html_functions.sanitize_inline(F.col("s")).alias("x")).collect()}
    assert got == {t: html.escape(html.unescape(t)) for t in texts}
    tagged = spark.createDataFrame([("a &amp</title><b>p</b>",)], "s string").select(html_functions.sanitize_inline(F.col("s"))).first()[0]
    assert tagged == "a &amp;<b>p</b>"
