"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import html_extract, language_id, line_dedup, media, mixing, packing, quality_classifier, quality_rules, simhash, token_store
from brindle.llm.encoding import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, target string, _lines int"
LONG = "the of and to " + " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [
    (1, "the cat sat on the mat and it was of a good kind " * 3, "en", "s1"),
    (1, "the cat sat on the mat and it was of a good kind " * 3, "en", "s1"),
    (2, None, None, None),
    (3, "", "en", "s1"),
    (None, "der hund und die katze sind nicht in dem haus", "de", None),
    (4, "  \n \t", "de", "s2"),
    (5, "12 34 !!", None, "s2"),
    (6, LONG, "en", "s3"),
    (7, "der hund und die katze sind nicht in dem haus", "de", "s2"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "x", "y", 7) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def tokens(name: str) -> str:
    return token_store.tokenizer_path(name)


def test_quality_rules(docs, empty):
    got = quality_rules.apply_rules(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_words"] == by[3]["n_words"] == by[4]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"]
    assert by[6]["n_words"] == 60_004 and by[6]["n_repeat_words"] == 60_000
    assert quality_rules.apply_rules(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.with_draws(docs).select(F.col("_mix_size").alias("_size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_draws").alias("draws"), "source").collect()
    assert len(got) == len(ROWS)
    assert all(r["target"] is not None and sum(d["words"] for d in r["draws"]) <= 2 * r["_size"] for r in got)
    for source in ("s1", "s2", "s3", None):
        mine = [r for r in got if r["source"] == source]
        taken, target = sum(sum(d["words"] for d in r["draws"]) for r in mine), mine[0]["target"]
        assert abs(taken - target) <= 20 and target <= 2 * mine[0]["source_size"]
    mixed = mixing.mix(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    assert words["s3"] == round(next(r["target"] for r in got if r["source"] == "s3"))
    assert mixing.with_draws(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_split_is_exact():
    quotas = np.array([100, 50, 3, 0])
    dealt = mixing.split(quotas, 8)
    assert (dealt.sum(axis=1) == quotas).all() and dealt.min() >= 0
    assert dealt.sum(axis=0).max() - dealt.sum(axis=0).min() <= 1
    assert (dealt == mixing.split(quotas, 8)).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_is_the_library_s(name):
    e = Encoder(tokens(name))
    texts = ["", " ", "  a", "a  b", " a b ", "a \n b", "x\n\n y", "don't 's  it's", "a b", "a\tb c", "a \x1c b \x01 c", "ΑΣ ΑΣ", "<|endoftext|> x", "e ́x", "12 345,67", LONG]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want


def test_token_store(docs, empty):
    manifest = token_store.write(docs, tokens("byte_bpe_50k.json"), 2)
    got = token_store.read(manifest).collect()
    assert len(got) == len(ROWS)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:], strict=False))
    assert [x.tolist() for x in token_store.lookup(manifest, 3)] == [[2]]
    assert len(token_store.lookup(manifest, 1)) == 2 and len(token_store.lookup(manifest, None)) == 1
    assert token_store.lookup(manifest, 12345) == []
    assert token_store.read(token_store.write(empty, tokens("byte_bpe_50k.json"), 2)).count() == 0


def test_packing(docs, empty):
    got = packing.pack(docs, tokens("word_bpe_49k.json"), 1).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    e = Encoder(tokens("word_bpe_49k.json"))
    assert sum(r["length"] for r in got) == sum(len(x) // 4 + 1 for x in e.encode([r[1] or "" for r in ROWS]))
    assert packing.pack(empty, tokens("word_bpe_49k.json"), 1).count() == 0


def test_packing_plan_places_every_piece():
    r = np.random.default_rng(1)
    counts = {int(c): int(n) for c, n in zip(r.choice(np.arange(1, 129), 60, replace=False), r.integers(1, 400, 60), strict=True)} | {256: 9}
    planned = packing.plan(counts, 256)
    got = sum(times * pattern for times, pattern in planned)
    assert {c: int(n) for c, n in enumerate(got) if n} == counts
    assert all((pattern * np.arange(257)).sum() <= 256 for _, pattern in planned)
    used, least = sum(t for t, _ in planned), sum(c * n for c, n in counts.items()) / 256
    assert used <= 1.02 * least + 3
    assert packing.plan({}, 256) == []


def test_html(spark):
    pages = spark.createDataFrame(
        [
            (1, "u", '<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><main><h1>Title</h1><p>First &amp; second\n <b>bold</b> text.<br>More<div class="ad">Buy</div><p>Short.<script>var a="<p>x</p>";</script></main><aside>Side text</aside><section id="comments"><p>I liked it a lot, what a fine article this is</p></section><form><label>Name</label></form><footer>c</footer>', 5),
            (2, None, None, 5), (3, "u", "", 5), (4, "u", "<p>plain words that make a paragraph of some length in a page", 5), (5, "u", "<<<>&am <p", 5), (1, "u", None, 5),
        ],
        "page_id long, url string, html string, n_chars int",
    )
    got = {(r["page_id"], r["n_chars"]): r["text"] for r in html_extract.main_text(pages).collect()}
    assert "Title\nFirst & second bold text. More\nShort." in got.values()
    assert got[(2, 0)] == got[(3, 0)] == got[(1, 0)] == ""
    assert "plain words that make a paragraph of some length in a page" in got.values()
    assert html_extract.main_text(pages.limit(0)).count() == 0
    tree = html_extract.grow(html_extract.LABELLED)
    assert (html_extract.judge(tree, html_extract.LABELLED[:, :-1]) == (html_extract.LABELLED[:, -1] == 1)).all()


def test_line_dedup(spark, docs, empty):
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(docs).collect()}
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == "  \n \t"
    rows = [(i, f"menu\nown {i}\n\nmenu" if i < 12 else f"other {i}", "a" if i < 60 else "b") for i in range(80)]
    df = spark.createDataFrame([*rows, (99, "menu", "b"), (98, "menu", "a")], "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in line_dedup.drop_lines(df).collect()}
    assert out[0]["text"] == "own 0\n" and out[0]["n_dropped"] == 2 and out[98]["text"] == "" and out[99]["text"] == "menu"
    assert line_dedup.drop_lines(empty).count() == 0


def test_quality_classifier(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    for table in (labels, labels.limit(0)):
        got = quality_classifier.predict(docs, quality_classifier.fit(docs, table)).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.predict(empty, quality_classifier.fit(docs, labels)).count() == 0


def test_language_id(docs, empty):
    got = language_id.predict(docs, language_id.fit(docs)).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {2, 3, 4, 5}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language_id.predict(docs, {}).collect()} == {"und"}
    assert language_id.keep_identified(docs).columns == docs.columns
    assert language_id.keep_identified(empty).count() == 0


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    ids: dict = {}
    for r in got:
        ids.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert ids == {1: {1}, 2: {2}, 3: {2}, 4: {2}, None: {7}, 5: {5}, 6: {6}, 7: {7}}
    kept = [r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()]
    assert sorted(kept, key=str) == [1, 2, 5, 6, 7]  # the row without an id is a copy of 7
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_against_brute_force(spark):
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 900)
    points = {int(b) ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 5), replace=False)) for b in base for _ in range(3)}
    fps = np.array(sorted(points), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    label = {int(x): i for i, x in enumerate(fps)}
    brute, found = list(range(len(fps))), list(range(len(fps)))

    def join(parent, a, b):
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def roots(parent):
        out = []
        for i in range(len(parent)):
            while parent[i] != i:
                i = parent[i]
            out.append(i)
        return out

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3):
            join(brute, i, i + 1 + int(j))
    for row in simhash.links(df, len(fps)).collect():
        a, b = (label[v & (2**64 - 1)] for v in (row["a"], row["b"]))
        assert bin(int(fps[a]) ^ int(fps[b])).count("1") <= 3
        join(found, a, b)
    assert roots(brute) == roots(found) and len(set(roots(brute))) < len(fps)


def test_media(docs, empty):
    got = media.features(media.store(docs)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next((x[1] or "") for x in ROWS if x[0] == r["doc_id"]).encode()
        payload = text + b"\xff" * (576 * max(1, -(-len(text) // 576)) - len(text))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(text), len(payload), zlib.crc32(payload[-32:]))
    assert media.features(media.store(empty)).count() == 0


def test_pipeline(spark, docs, empty):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (plain, plain.limit(0)):
        at = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            at = stage(spark, at, "")
            if i < 4:
                assert at.columns == plain.columns
        assert set(at.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
        assert (at.count() > 0) == (start is plain)


CLASHES = ("n_lines", "n_dropped", "_text", "_lang_pred", "_lang_rejected", "_near_id", "_key_id", "_mix_key", "_mix_draws", "_mix_pass", "_site_host", "_row", "rejected", "score")


def test_pipeline_keeps_clashing_columns(docs):
    """Columns of any name come through every stage as they went in."""
    at = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    for _, stage in corpus_pipeline.STAGES[:4]:
        at = stage(docs.sparkSession, at, "")
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
        rows = at.collect()
        assert rows and {tuple(r[c] for c in CLASHES) for r in rows} == {tuple(f"own {c}" for c in CLASHES)}


def test_a_language_of_one_text_is_learned(spark):
    """However often a text is repeated, and whatever the ids, its language gets a dictionary."""
    czech = "žluťoučký kůň úpěl ďábelské ódy a všichni ho poslouchali až do večera"
    english = [(i, f"the cat number {i} sat on the mat and it was of a good kind {i * 7919}", "en") for i in range(400)]
    for same in range(12):
        rows = english + [(100_000 + same, czech, "cs")] * 4000
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = language_id.fit(docs)
        held = docs.where("lang = 'cs'").select(language_id.held_out(F.col("doc_id"))).first()[0]
        assert len(model["en"]) > 1000 and (held or len(model["cs"]) > 50)
        if not held:
            got = language_id.predict(docs.where("lang = 'cs'").limit(3), model).collect()
            assert {(r["lang_pred"], r["rejected"]) for r in got} == {("cs", False)}


def test_mixing_meets_targets_on_equal_rows(spark):
    """3,001 equal rows of one source: the words that the cut leaves are dealt one by one."""
    rows = [(7, "one two three four five", "b")] * 3001 + [(100 + i, "word " * (i % 9), "a") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.with_draws(docs).selectExpr("source", "_mix_size as size", "_mix_target as target", "aggregate(_mix_draws, 0L, (a, d) -> a + d.words) as taken").collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    for source in "ab":
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
    assert mixing.mix(docs).where("source = 'b'").selectExpr("sum(size(split(text, ' '))) as n").first()["n"] == sum(r["taken"] for r in got if r["source"] == "b")
