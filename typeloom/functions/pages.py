"""Results as HTML: one entry a row, and the links between pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


def escaped(value: Column) -> Column:
    """Text that markup cannot break out of."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def entry(signature: Column, module: Column, score: Column, link: Column, comment: Column) -> Column:
    """A result: its signature, linked if there is documentation elsewhere, module and score, and the comment, which is HTML already."""
    shown = escaped(signature)
    title = F.coalesce(F.concat(F.lit('<a href="'), escaped(link), F.lit('">'), shown, F.lit("</a>")), shown)
    body = F.when(F.coalesce(comment, F.lit("")) != "", F.concat(F.lit("<div>"), comment, F.lit("</div>"))).otherwise("")
    return F.concat(F.lit("<li><h3>"), title, F.lit("</h3><small>"), escaped(module), F.lit(" &middot; "), F.format_number(score, 2), F.lit("</small>"), body, F.lit("</li>"))


def page_link(query: Column, page: Column, last: Column) -> Column:
    """The address of the next page, or null after the last."""
    return F.when(page < last, text.link(F.lit("/search"), q=query, p=(page + 1).cast("string")))
