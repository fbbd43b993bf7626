"""The queries that SQL can't express against plain Python over the smallest tables."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import html_extract, language_id, line_dedup, media, mixing, near_copies, packing, quality_classifier, simhash, token_store

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def held(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def ids_of(file: str, text: str | None, end: int) -> np.ndarray:
    """By a tokenizer of its own, as the library reads it from the file."""
    from tokenizers import Tokenizer

    if file not in ids_of.__dict__:
        ids_of.__dict__[file] = Tokenizer.from_file(token_store.tokenizer_path(file))
    return np.array([*ids_of.__dict__[file].encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def water_level(sizes: dict, weights: dict) -> dict:
    """Shares of 150 % of all words by weight; what is above a cap of twice the source is reshared."""
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        share = {s: left * weights[s] / sum(weights[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark, documents):
    rows = mixing.query(spark, SF).collect()
    assert len(rows) == len(documents)
    names = sorted({d["source"] for d in documents.values()}, key=lambda s: (s is None, s))
    sizes = dict.fromkeys(names, 0)
    for d in documents.values():
        sizes[d["source"]] += len(WORD.findall(d["text"] or ""))
    want = water_level(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    taken = dict.fromkeys(names, 0)
    for r in rows:
        d = documents[r["doc_id"]]
        assert r["size"] == len(WORD.findall(d["text"] or "")) and r["source_size"] == sizes[d["source"]]
        assert r["target"] == pytest.approx(want[d["source"]], abs=1e-6) and 0 <= r["taken"] <= 2 * r["size"]
        taken[d["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    again = mixing.query(spark, SF).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixing_runs_are_disjoint_and_whole(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), ("c", 0), ("d", 5)], "key string, n long")
    for shards in (8, 200):
        found = sorted(mixing.runs(quotas, shards).collect(), key=lambda r: (r["key"], r["shard"]))
        for key, n in (("a", 1000), ("b", 37), ("d", 5)):
            mine = [r for r in found if r["key"] == key]
            at = 0
            for r in mine:
                assert r["first"] == at
                at += r["n"]
            assert at == n
        loads = Counter()
        for r in found:
            loads[r["shard"]] += r["n"]
        assert max(loads.values()) - min(loads.get(i, 0) for i in range(shards)) <= 1
        # the lower levels give what the driver would give
        dealt = mixing.split(np.array([1000, 37, 0, 5]), shards)
        assert {(r["key"], r["shard"]): r["n"] for r in found} == {("abcd"[k], i): int(dealt[k, i]) for k, i in zip(*np.nonzero(dealt), strict=True)}


def test_token_store(spark, documents):
    got = {r["doc_id"]: r for r in token_store.query(spark, SF).collect()}
    at = 0
    assert len(got) == len(documents)
    for i in sorted(documents):
        ids = ids_of("byte_bpe_50k.json", documents[i]["text"], 2)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packing(spark, documents):
    whole = {i: ids_of("word_bpe_49k.json", d["text"], 1) for i, d in documents.items()}
    rows, covered, places = packing.query(spark, SF).collect(), {}, {}
    for r in rows:
        ids = whole[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, total in [*((covered[i], len(ids)) for i, ids in whole.items()), *((p, None) for p in places.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total or total is None and at <= 2048
    filled = sum(len(x) for x in whole.values()) / 2048 / len(places)
    assert filled > 0.97


def test_special_marks_in_texts_are_the_library_s(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "<|ENDOFTEXT|>x"), (3, "<|startoftext|><|endoftext|>"), (4, "<|endof text|>"), (5, None), (6, "<|" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = {r["doc_id"]: r["ids_crc32"] for r in token_store.read(token_store.write(docs, token_store.tokenizer_path("byte_bpe_50k.json"), 2)).collect()}
    packed = {r["doc_id"]: r["ids_crc32"] for r in packing.pack(docs, token_store.tokenizer_path("word_bpe_49k.json"), 1).collect()}
    for i, text in rows:
        assert stored[i] == zlib.crc32(ids_of("byte_bpe_50k.json", text, 2).tobytes())
        assert packed[i] == zlib.crc32(ids_of("word_bpe_49k.json", text, 1).tobytes())


def test_media(spark, documents):
    got = {r["doc_id"]: r for r in media.query(spark, SF).collect()}
    assert len(got) == len(documents)
    by_text: dict = {}
    for i, d in documents.items():
        raw, r = (d["text"] or "").encode(), got[i]
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        stored = media.to_wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == " ".join(f"{x['t']}:{x['code']:x}" for x in r["landmarks"])
        assert by_text.setdefault(d["text"], r["feature"]) == r["feature"]
    assert len({r["feature"] for r in got.values()}) > len(got) / 2


def test_landmarks_of_a_tone():
    """A pure tone peaks at its own bin in every frame; pairs join it to itself at each step."""
    n, bin_ = 576 * 4, 50
    tone = (128 + 100 * np.sin(2 * np.pi * bin_ * np.arange(n) / 576)).astype(np.uint8)
    frame, band, at = media.peaks(tone)
    assert set(at[band == 1]) == {bin_} and sorted(frame[band == 1]) == list(range(7))
    codes = {c for _, c in media.pairs(tone)}
    assert {bin_ << 12 | bin_ << 3 | step for step in (1, 2, 3)} <= codes


def plain_fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(n: int, edges) -> list[int]:
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash(spark, documents):
    order = sorted(documents)
    fps = np.array([plain_fingerprint(documents[i]["text"]) for i in order], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    roots = roots_of(len(order), zip(*np.nonzero(np.triu(near, 1)), strict=True))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, SF).collect()}
    assert got == {i: (f"{int(f):016x}", order[k]) for i, f, k in zip(order, fps, roots, strict=True)}


def test_simhash_trees_with_many_shards(spark, monkeypatch):
    """Small shards and tiles: visits across shards, tiles and a large group of near copies."""
    for name, value in (("SHARD", 64), ("LEAF", 16), ("PER_SAMPLE", 4), ("TILE", 100)):
        monkeypatch.setattr(simhash, name, value)
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 400).tolist()
    group = [base[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 64, (400, 2)) if a != b]
    points = {int(b) ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 5), replace=False)) for b in base for _ in range(3)} | set(group)
    fps = np.array(sorted(points), dtype=np.uint64)
    found = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), len(fps)).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    edges = [(at[x["a"]], at[x["b"]]) for x in found]
    assert all(near[a, b] for a, b in edges)
    assert roots_of(len(fps), edges) == roots_of(len(fps), zip(*np.nonzero(np.triu(near, 1)), strict=True))


def test_pages(spark):
    """Every page's text is that of its article, read with plain patterns."""
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    got = {r["page_id"]: r for r in html_extract.query(spark, SF).collect()}
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p["html"], re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(x for x in parts if x)
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"]) == (text, len(text))


LONG = "This paragraph runs on for quite a few words so that nobody would take it for a menu or an advert at all."
HAND_MARKED = [
    # no article element, no telling names: (html, main text)
    (f"<body><ul><li><a>Home</a><li><a>News</a><li><a>Sport</a></ul><div>Buy shoes here today</div><h1>A title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><div>All rights are kept by us</div></body>", f"A title\n{LONG}\nShort one.\n{LONG}"),
    (f"<div><a>One</a> <a>Two</a> <a>Three</a></div><div>{LONG}</div><div>{LONG} <a>more</a></div><div><a>Next page</a></div>", f"{LONG}\n{LONG} more"),
    (f"<table><tr><td><a>In</a></td><td><a>Out</a></td></tr></table><h2>Heads</h2><p>{LONG}</p><div>Ad</div><p>{LONG}</p><p>End.</p>", f"Heads\n{LONG}\n{LONG}\nEnd."),
    (f"<p>{LONG}</p><aside><p>{LONG}</p></aside><section class='comments'><p>{LONG}</p></section><footer><p>{LONG}</p></footer>", LONG),
    (f"<nav><p>Some words without a link</p></nav><main><p>{LONG}</p></main><form><label>Your name</label></form>", LONG),
]


def test_hand_marked_pages():
    tree = html_extract.grow(html_extract.LABELLED)
    for page, text in HAND_MARKED:
        assert html_extract.extract(page, tree) == text


def test_words_and_links_of_neighbours_decide():
    tree = html_extract.grow(html_extract.LABELLED)
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    changed = {"neighbours": 0, "all": 0}
    for p in pages:
        rows = html_extract.feature_table(html_extract.blocks(p["html"]))
        for name, words, links in (("neighbours", [2, 4], [3, 5]), ("all", [0, 2, 4], [1, 3, 5])):
            blind = rows.copy()
            blind[:, words], blind[:, links] = 10, 0
            changed[name] += bool((html_extract.judge(tree, rows) != html_extract.judge(tree, blind)).any())
    assert changed["all"] == len(pages) and changed["neighbours"] > len(pages) / 3


def test_deep_and_stray_tags_are_linear():
    page = "<div>" * 60_000 + "x" + "</section>" * 60_000
    assert [b.text for b in html_extract.blocks(page)] == ["x"]


def test_pairwise_part_is_the_sum_over_pairs():
    r = np.random.default_rng(2)
    v, x = r.normal(size=(30, 8)), r.normal(size=30)
    plain = sum(float(v[i] @ v[j]) * x[i] * x[j] for i, j in combinations(range(30), 2))
    assert quality_classifier.pairwise(v, x) == pytest.approx(plain)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = quality_classifier.query(spark, sf).collect()
    assert all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    judged = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(judged) > 50 and sum(judged) / len(judged) > 0.9


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(3000)] + [(4, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (99, 1)], "doc_id long, quality int")
    seen = []
    was = quality_classifier.train
    try:
        quality_classifier.train = lambda rows, seed=5: seen.append(len(rows)) or was(rows, seed)
        quality_classifier.fit(docs, labels, most=8)
    finally:
        quality_classifier.train = was
    assert seen == [4]


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = language_id.query(spark, sf).collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    judged = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(judged) > 200 and sum(judged) / len(judged) > 0.97


def test_language_of_long_and_repeated_rows(spark):
    """A language of long texts alone is learned; a hot id and text give one slice."""
    french, english = "les chats dorment sous la grande table ronde avec leurs amis ", "the quick dogs are running through that green field with their friends "
    rows = [(i, french * 3600 + str(i), "fr") for i in range(8)] + [(100 + i, english + str(i), "en") for i in range(40)] + [(7, english, "en")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(docs)
    assert len(model["fr"]) > 1000 and model["en"].count(english.strip().encode()) <= 42
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert {got[i] for i in range(7)} == {"fr"} and {got[100 + i] for i in range(40)} == {"en"}


BIG = [9007199254740993, 9007199254740995, None, 5]


def test_ids_beyond_doubles_stay(spark):
    docs = spark.createDataFrame([(i, f"some words of text {k} that differ, number {k * 7919}") for k, i in enumerate(BIG)], "doc_id long, text string").coalesce(1)
    tokenizer = token_store.tokenizer_path("byte_bpe_50k.json")
    labels = spark.createDataFrame([(5, 1), (BIG[0], 0)], "doc_id long, quality int")
    manifest = token_store.write(docs, tokenizer, 2)
    results = {
        "token_store": token_store.read(manifest),
        "token_store by keys": token_store.read(manifest, docs),
        "quality_classifier": quality_classifier.predict(docs, quality_classifier.fit(docs, labels)),
        "language_id": language_id.predict(docs, {"en": b"some words", "fr": b"des mots"}),
        "simhash": simhash.near_duplicates(docs),
        "keep_one": simhash.keep_one(docs),
        "media": media.features(media.store(docs)),
        "packing": packing.pack(docs, tokenizer, 1),
    }
    for name, df in results.items():
        assert sorted((r["doc_id"] for r in df.collect()), key=str) == sorted(BIG, key=str), name


def test_token_store_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(token_store, "FULL_DOCS", 50)
    rows = [(None if i % 3 == 0 else 1 if i % 3 == 1 else i, f"text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_store.write(docs, token_store.tokenizer_path("byte_bpe_50k.json"), 2)
    assert manifest.where("n_null > 0").count() > 1 and manifest.where("first_key = 1").count() > 1
    got = token_store.read(manifest, docs.select("doc_id")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert len(token_store.lookup(manifest, None)) == 200 and len(token_store.lookup(manifest, 1)) == 200
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_keep_one_keeps_unlike_texts_of_one_id(spark):
    rows = [(1, "one text of some words here", "a"), (1, "quite another text altogether", "a"), (None, "one text of some words here", "b"), (None, "a third text with no id", "b"), (3, "twice the same row", "c"), (3, "twice the same row", "c"), (3, "twice the same row", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `near.key` string")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.select("doc_id", "text").collect()), key=str) == sorted([(1, rows[0][1]), (1, rows[1][1]), (None, rows[3][1]), (3, rows[4][1])], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_site_lines_by_host(spark):
    pages = spark.createDataFrame([(i, f"https://user@{'A.example.org' if i % 2 else 'b.example.org:80'}/{i}", f"Menu {i % 2}\nown {i}") for i in range(40)] + [(99, None, "Menu 0"), (98, "no url", "x")], "page_id long, url string, text string")
    hosts = pages.withColumn("host", line_dedup.host_of(pages["url"]))
    assert {r["host"] for r in hosts.collect()} == {"a.example.org", "b.example.org", None}
    out = {r["page_id"]: r["text"] for r in line_dedup.drop_lines(hosts, host="host").collect()}
    assert all(out[i] == f"own {i}" for i in range(40)) and out[99] == "Menu 0"


def test_clashing_names_in_every_stage(spark):
    names = "block key luck size n label node id text_hash copies component s fp luck2 word slice"
    docs = spark.createDataFrame([(i, f"the cat and the dog are in the house with a friend number {i} " * 3, "en", f"s{i % 3}", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    for n in names.split():
        docs = docs.withColumn(n, docs["doc_id"] * 2)
    at = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        at = stage(spark, at, "")
        assert at.columns == docs.columns
        assert all(r["block"] == r["doc_id"] * 2 == r["slice"] for r in at.collect())
    assert corpus_pipeline.STAGES[4][1](spark, at, "").count() > 0


def test_pipeline_against_plain_stages(spark, documents):
    """Each stage of the pipeline on its own input, by plain Python."""
    at = spark.read.parquet(f"{SF}/documents.parquet")
    # language ID: rows with a telling language stay as they are
    kept = corpus_pipeline.identify_language(spark, at, SF)
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert all(rows[i].asDict() == documents[i] for i in rows) and len(rows) > 0.97 * len(documents)
    # line dedup: lines on more than the ratio of a source's pages, three at least
    lines, pages = Counter(), Counter()
    for r in rows.values():
        pages[r["source"]] += 1
        lines.update((r["source"], x) for x in set((r["text"] or "").split("\n")) if WORD.search(x))
    bad = {k for k, n in lines.items() if n >= line_dedup.LEAST and n > line_dedup.RATIO * pages[k[0]]}
    cleaned = corpus_pipeline.drop_boilerplate(spark, kept, SF)
    clean = {r["doc_id"]: r for r in cleaned.collect()}
    for i, r in rows.items():
        want = "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad)
        assert (clean[i]["text"], clean[i]["n_chars"]) == (want, len(want))
    # near-dedup: one of each component at Jaccard 0.8 over five-word shingles
    order = sorted(clean)
    sets = []
    for i in order:
        words = WORD.findall(clean[i]["text"].lower())
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    edges = [(a, b) for a, b in combinations(range(len(order)), 2) if 100 * len(sets[a] & sets[b]) >= near_copies.SIMILAR * len(sets[a] | sets[b])]
    single = corpus_pipeline.drop_near_duplicates(spark, cleaned, SF)
    stay = sorted(r["doc_id"] for r in single.collect())
    assert stay == sorted({order[k] for k in roots_of(len(order), edges)})
    # mixing: every source near its target, texts whole or cut behind
    mixed = corpus_pipeline.mix_sources(spark, single, SF).collect()
    sizes, taken = Counter(), Counter()
    for i in stay:
        sizes[clean[i]["source"]] += len(WORD.findall(clean[i]["text"]))
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert clean[r["doc_id"]]["text"].startswith(r["text"])
    names = sorted(sizes, key=lambda s: (s is None, s))
    want = water_level(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    # packing: all ids of all that was mixed
    pieces = corpus_pipeline.pack_sequences(spark, spark.createDataFrame(mixed), SF).collect()
    assert sum(r["length"] for r in pieces) == sum(len(ids_of("word_bpe_49k.json", r["text"], 1)) for r in mixed)


def test_a_lookup_reads_little(spark):
    """Some words of the index, whatever the shard's size; unknown keys are told apart."""
    docs = spark.range(20_000).selectExpr("id * 3 as doc_id", "concat('word ', id) as text").coalesce(1)
    manifest = token_store.write(docs, token_store.tokenizer_path("byte_bpe_50k.json"), 2)
    row = manifest.orderBy(F.desc("n_docs")).first()
    ids_of_all = {r["doc_id"]: r["n_tokens"] for r in token_store.read(manifest).collect()}
    for key in (row["first_key"], row["first_key"] + 300, row["last_key"], row["first_key"] + 1):
        shard = token_store.Shard(row["uri"], whole=False)
        head = shard.n_read
        found = shard.get(key)
        assert (len(found) == 1 and len(found[0]) == ids_of_all[key]) if key % 3 == 0 else found == []
        assert shard.n_read - head - sum(x.nbytes for x in found) < 200 and head < 4096 and row["n_docs"] > 1000
        assert [x.tolist() for x in token_store.lookup(manifest, key)] == [x.tolist() for x in found]


def test_keys_meet_shards_through_marks(spark, monkeypatch):
    """Few marks for many shards; repeated, unknown and null keys."""
    monkeypatch.setattr(token_store, "FULL_DOCS", 7)
    monkeypatch.setattr(token_store, "MARKS", 3)
    rows = [(i // 2 if i % 11 else None, f"text {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_store.write(docs, token_store.tokenizer_path("byte_bpe_50k.json"), 2)
    assert manifest.count() > 50
    asked = spark.createDataFrame([(k,) for k in [*range(-5, 150), None, None, 3, 3]], "doc_id long")
    got = [r["doc_id"] for r in token_store.read(manifest, asked).collect()]
    want = [k for k, _ in rows if k is None or k < 150]
    assert sorted(map(str, got)) == sorted(map(str, want))
    plan = token_store.read(manifest, asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan
