"""Rendering columns: paragraphs and lists as editor blocks, Markdown lines, scorecard numbers."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import html as html_functions
from . import udfs
from .scores import number_text
from .text import blank, clean_text, or_null
from .text import lookup as text_lookup

def attribution(photographer: Column, page: Column) -> Column:
    """The credit of a stock photo, with what is known of its maker and page."""
    who, link = or_null(clean_text(photographer)), or_null(F.trim(blank(page)))
    anchor = F.concat(F.lit('<a href="'), link, F.lit('" target="_blank" rel="nofollow noopener">Link</a>'))
    return F.concat(F.lit("<p><small>"), F.concat_ws(" — ", F.lit("Image: Pexels"), F.when(link.isNotNull(), who), anchor), F.lit("</small></p>"))


def faq(items: Column, heading: str = "سوالات متداول", limit: int = 4) -> Column:
    """Questions and answers, array<struct<question, answer>>, as headings and paragraphs; empty without any."""
    fit = F.slice(F.filter(items, lambda x: (blank(x["question"]) != "") & (blank(x["answer"]) != "")), 1, limit)
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), html_functions.escape(c), F.lit(f"</{name}>"))
    each = F.transform(fit, lambda x: F.concat(tag("h3", F.substring(x["question"], 1, 160)), F.lit("\n"), tag("p", F.substring(x["answer"], 1, 500))))
    return F.when(F.size(fit) > 0, F.concat(F.lit(f"<h2>{heading}</h2>\n"), F.array_join(each, "\n"))).otherwise("")


#: fixed values: what is a block of its own, and how the editor delimits blocks
PIECE = r"(?is)<p\b[^>]*>(.*?)</p>|<ul\b[^>]*>(.*?)</ul>"
ITEM = r"(?is)<li\b[^>]*>(.*?)</li>"
_CUT, _PART, _FRAGMENT, _PIECE = "\x01", "\x02", "\x03", "\x04"


def paragraph(inner: Column) -> Column:
    """A paragraph block; empty if there is nothing in it."""
    body = F.trim(blank(inner))
    return F.when(body != "", F.concat(F.lit("<!-- wp:paragraph -->\n<p>"), body, F.lit("</p>\n<!-- /wp:paragraph -->"))).otherwise("")


def bullets(items: Column) -> Column:
    """A list block of rendered items; empty without any."""
    each = F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit("<!-- wp:list-item -->\n<li>"), x, F.lit("</li>\n<!-- /wp:list-item -->")))
    return F.when(F.size(each) > 0, F.concat(F.lit('<!-- wp:list -->\n<ul class="wp-block-list">\n'), F.array_join(each, "\n"), F.lit("\n</ul>\n<!-- /wp:list -->"))).otherwise("")


def article(fragment: Column, sanitize: bool = True) -> Column:
    """An article as editor blocks, in order: paragraphs and lists with their inline formatting, text between them as paragraphs.

    The fragment is cut at its paragraphs and lists; the inner fragments of all pieces are sanitized together, with one
    call for their entities, and each piece is rendered by its kind. ``sanitize=False``: inline markup stays as it is, as in
    the first generation.
    """
    raw = F.trim(blank(fragment))
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(raw, "[\x01-\x04]", ""), f"({PIECE})", f"{_CUT}$1{_CUT}"), _CUT), lambda x: x != "")
    is_paragraph, is_list = (lambda x, t=t: x.rlike(rf"(?is)^<{t}\b[^>]*>.*</{t}>$") for t in ("p", "ul"))
    inner = lambda x, t: F.regexp_extract(x, rf"(?is)^<{t}\b[^>]*>(.*)</{t}>$", 1)
    within = lambda x: F.when(is_paragraph(x), F.array(inner(x, "p"))).when(is_list(x), F.regexp_extract_all(inner(x, "ul"), F.lit(ITEM), F.lit(1))).otherwise(F.array().cast("array<string>"))
    pieces = F.transform(parts, lambda x: F.transform(within(x), html_functions.inline_pieces))
    # all texts travel as one for their entities
    joined = F.array_join(F.transform(pieces, lambda x: F.array_join(F.transform(x, lambda y: F.array_join(y, _PIECE)), _FRAGMENT)), _PART)
    plain = F.transform(F.split(udfs.unescape(joined), _PART), lambda x: F.transform(F.split(x, _FRAGMENT), lambda y: F.split(y, _PIECE)))
    text = lambda x: paragraph(html_functions.escape(clean_text(x)))

    def block(x: Column) -> Column:
        done = F.zip_with(x["pieces"], x["plain"], html_functions.sanitized) if sanitize else F.transform(x["pieces"], lambda y: F.trim(F.array_join(y, "")))
        listed = F.when(F.size(x["pieces"]) > 0, bullets(done)).otherwise(text(inner(x["part"], "ul")))
        return F.when(is_paragraph(x["part"]), paragraph(F.coalesce(F.get(done, F.lit(0)), F.lit("")))).when(is_list(x["part"]), listed).otherwise(text(x["part"]))

    rows = F.arrays_zip(parts.alias("part"), pieces.alias("pieces"), plain.alias("plain"))
    found = F.filter(F.transform(rows, block), lambda x: x != "")
    return F.when(F.size(found) > 0, F.array_join(found, "\n\n")).otherwise(text(raw))


def image(url: Column, alt: Column, media_id: Column, width: Column) -> Column:
    """An image block; at most as wide as the image itself. Empty without an address."""
    has_id, has_width = media_id.isNotNull() & (media_id > 0), width.isNotNull() & (width > 0)
    fields = F.concat(F.lit('{"sizeSlug":"full","linkDestination":"none"'), F.when(has_id, F.concat(F.lit(',"id":'), media_id.cast("string"))).otherwise(""), F.lit("}"))
    named = F.when(has_id, F.concat(F.lit(' class="wp-image-'), media_id.cast("string"), F.lit('"'))).otherwise("")
    style = F.when(has_width, F.concat(F.lit(' style="max-width:'), width.cast("string"), F.lit('px;width:100%;height:auto"'))).otherwise("")
    tag = F.concat(F.lit('<img src="'), html_functions.escape(F.trim(blank(url))), F.lit('" alt="'), html_functions.escape(clean_text(alt)), F.lit('"'), named, style, F.lit("/>"))
    return F.when(F.trim(blank(url)) != "", F.concat(F.lit("<!-- wp:image "), fields, F.lit(' -->\n<figure class="wp-block-image size-full">'), tag, F.lit("</figure>\n<!-- /wp:image -->"))).otherwise("")


def links(heading: Column, found: Column) -> Column:
    """A heading and a list of (title, link) as blocks; empty without any."""
    each = F.transform(found, lambda x: F.concat(F.lit('<a href="'), html_functions.escape(x["link"]), F.lit('">'), html_functions.escape(clean_text(x["title"])), F.lit("</a>")))
    return F.when(F.size(found) > 0, F.concat(F.lit("<!-- wp:heading -->\n<h2>"), html_functions.escape(heading), F.lit("</h2>\n<!-- /wp:heading -->\n\n"), bullets(each))).otherwise("")


def document(*parts: Column) -> Column:
    """Parts in order, empty ones left out."""
    return F.concat_ws("\n\n", *(or_null(F.trim(blank(p))) for p in parts))


def tier(score: Column) -> Column:
    return F.when(score >= 9, "outstanding").when(score >= 8, "great").when(score >= 7, "good").when(score >= 5.5, "fair").otherwise("weak")


def ring_offset(score: Column) -> Column:
    return F.round(F.lit(339.292) * (1 - score / 10), 3)


VERDICTS = ["شاهکار", "ارزش تجربه", "انتخاب خوب", "متوسط", "پیشنهاد نمی‌شود"]
COLORS = ["#e7b24e", "#f0637e", "#d22b4b", "#c9974a", "#948da3"]
_TIERS = ["outstanding", "great", "good", "fair", "weak"]


def scorecard(style: Column, overall: Column, rows: Column, eyebrow: str, prefix: str = "score") -> Column:
    """The scorecard as one line of markup: a ring for the overall score, a bar for each of ``rows``, array<struct<label, score_10>>.

    Values are rendered, not scripted. ``style``: the text of a style sheet over the classes that begin with ``prefix``. Empty
    without an overall score or rows.
    """
    score = F.least(F.greatest(overall, F.lit(0.0)), F.lit(10.0))
    named = lambda values: text_lookup(tier(score), dict(zip(_TIERS, values, strict=True)))
    fixed = lambda c, places: F.format_string(f"%.{places}f", c)
    tag = lambda kind, body, name="div", more="": F.concat(F.lit(f'<{name} class="{prefix}-{kind}"{more}>'), body, F.lit(f"</{name}>"))
    out_of = F.lit("<small>/10</small>")

    def bar(x: Column) -> Column:
        s = F.least(F.greatest(x["score_10"].cast("double"), F.lit(0.0)), F.lit(10.0))
        head = tag("top", F.concat(tag("label", html_functions.escape(clean_text(x["label"])), "span"), tag("value", F.concat(number_text(s), out_of), "span")))
        fill = F.concat(F.lit(f'<div class="{prefix}-fill" style="width:'), fixed(bar_width(s), 1), F.lit('%"></div>'))
        return tag("row", F.concat(head, tag("track", fill)))

    circle = f'<circle class="{prefix}-%s" cx="60" cy="60" r="54"'
    ring = F.concat(
        F.lit('<svg viewBox="0 0 120 120" role="img">' + circle % "ring" + "></circle>" + circle % "arc" + ' stroke-dasharray="339.292" stroke-dashoffset="'), fixed(ring_offset(score), 3), F.lit('"></circle></svg>'),
        tag("number", F.concat(number_text(score), out_of)),
    )
    verdict = tag("verdict", F.concat(tag("eyebrow", F.lit(eyebrow)), tag("wrap", ring), tag("word", named(VERDICTS))))
    whole = F.concat(
        F.lit(f'<div data-scorecard="1" class="{prefix}-widget" dir="rtl" style="--tier:'), named(COLORS), F.lit('"><style>'), style, F.lit("</style>"),
        verdict, F.lit(f'<div class="{prefix}-divider"></div>'), tag("aspects", F.array_join(F.transform(rows, bar), "")), F.lit("</div>"),
    )
    return F.when(overall.isNotNull() & (F.size(rows) > 0), whole).otherwise("")


def bar_width(score: Column) -> Column:
    return F.round(score * 10, 1)


_INLINE = [(re.compile(r"\*\*(.+?)\*\*"), r"<strong>\1</strong>"), (re.compile(r"(?<!\*)\*([^*]+)\*"), r"<em>\1</em>"), (re.compile(r"\[([^\]]+)\]\((https?://[^)\s]+)\)"), r'<a href="\2">\1</a>')]


def _inline(text: str) -> str:
    out = html.escape(text, quote=False)
    for pattern, with_ in _INLINE:
        out = pattern.sub(with_, out)
    return out


def _markdown(source: str | None) -> str:
    """Lines grouped by kind, each group rendered at once; a line that opens a tag stays as it is."""
    kinds = {"#": "heading", "-": "bullet", "*": "bullet", ">": "quote", "|": "row", "<": "raw"}
    groups: list[tuple[str, list[str]]] = []
    for line in (source or "").splitlines():
        text = line.strip()
        kind = "" if not text else "rule" if re.fullmatch(r"-{3,}|\*{3,}", text) else kinds.get(text[0], "text")
        if kind == "bullet" and not re.match(r"[-*]\s", text):
            kind = "text"
        if groups and groups[-1][0] == kind and kind not in ("heading", "rule"):
            groups[-1][1].append(text)
        else:
            groups.append((kind, [text]))
    out = []
    for kind, lines in groups:
        if kind == "heading":
            level = len(lines[0]) - len(lines[0].lstrip("#"))
            tag = f"h{min(level + 1, 6)}"
            out.append(f"<{tag}>{_inline(lines[0].lstrip('# '))}</{tag}>")
        elif kind == "bullet":
            out.append("<ul>" + "".join(f"<li>{_inline(x[1:].strip())}</li>" for x in lines) + "</ul>")
        elif kind == "quote":
            out.append("<blockquote><p>" + " ".join(_inline(x[1:].strip()) for x in lines) + "</p></blockquote>")
        elif kind == "row":
            rows = [[_inline(c.strip()) for c in x.strip("|").split("|")] for x in lines if not re.fullmatch(r"\|?[\s:|-]+\|?", x)]
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>")
        elif kind == "rule":
            out.append("<hr>")
        elif kind == "raw":
            out.append("\n".join(lines))
        elif kind:
            out.append("<p>" + " ".join(map(_inline, lines)) + "</p>")
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def markdown(c: pd.Series) -> pd.Series:
    return c.map(_markdown)
