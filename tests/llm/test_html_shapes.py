"""Main text of all given pages."""

from __future__ import annotations

import html
import re

from brindle.llm import html_extract


def test_all_pages(spark):
    """On the given pages the main text is what the article element holds."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = (html.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"</?(?:p|h1)>", re.sub(r"<(script|style).*?</\1>", "", article, flags=re.S)))
        assert got[r["page_id"]] == "\n".join(x for x in (re.sub(r"\s+", " ", p).strip() for p in parts) if x)
