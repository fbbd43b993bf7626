"""The line dedup stage on small sites and on both sides of the gap in line shares."""

from __future__ import annotations

import corpus_pipeline


def test_ratio_decides_at_every_size(spark):
    rows = []
    for site, pages, carrying in (("tiny", 8, 4), ("small", 50, 5), ("low", 500, 43), ("high", 500, 66), ("rare", 500, 24), ("pair", 8, 2)):
        rows += [(site, f"own {site} {i}\nmenu line" if i < carrying else f"own {site} {i}") for i in range(pages)]
    docs = spark.createDataFrame([(i, text, "en", site, len(text)) for i, (site, text) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_boilerplate(spark, docs, "").collect()
    assert len(out) == len(rows) and {r["source"] for r in out if "menu" in r["text"]} == {"rare", "pair"}
    assert all("own" in r["text"] and r["n_chars"] == len(r["text"]) for r in out)
