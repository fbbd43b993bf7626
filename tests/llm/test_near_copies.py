"""The near-dedup stage against brute force on planted copies of similarity 0.8 to 0.95."""

from __future__ import annotations

import numpy as np

from brindle.llm import near_copies, simhash, sketches


def _set(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_keep_one_against_brute_force(spark):
    r = np.random.default_rng(5)
    texts = []
    for base in range(60):
        words = [f"b{base}x{int(k)}" for k in r.integers(0, 10_000, int(r.integers(60, 400)))]
        texts.append(" ".join(words))
        for copy in range(4):
            # each changed word changes five shingles at most
            changed = words[:]
            for k in r.choice(len(words), max(1, int(len(words) * r.uniform(0.005, 0.03))), replace=False):
                changed[k] = f"new{base}x{copy}x{k}"
            texts.append(" ".join(changed))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"own{i}x{k}" for k in range(60)) for i in range(40)]
    sets, parent = [_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    similarities = []
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            similarity = both / (len(sets[i]) + len(sets[j]) - both)
            if similarity >= 0.8:
                similarities.append(similarity)
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert min(similarities) < 0.82 and sum(s < 0.9 for s in similarities) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(x["doc_id"] for x in simhash.keep_one(docs).collect())
    assert kept == sorted({root(i) for i in range(len(texts))})


def test_bitmaps_rule_out_no_similar_pair():
    r = np.random.default_rng(6)
    ruled_out = 0
    for n in (1, 2, 5, 9, 10, 50, 400, 3000):
        for _ in range(40):
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: int(len(a) * r.uniform(0.5, 1))], r.integers(0, 2**64, int(n * r.uniform(0, 0.3)), dtype=np.uint64)]))
            x, y = (np.frombuffer(near_copies.parities(s), np.uint8)[None, :] for s in (a, b))
            may = near_copies.may_be_similar(np.array([len(a)]), np.array([len(b)]), x, y)[0]
            assert may or not near_copies.similar(a, b)
            ruled_out += not may
    assert ruled_out > 100


def test_one_shingle_stands_for_all_that_the_same_texts_have(spark):
    # near copies share many shingles; each of them made every pair of theirs anew, and was shuffled every turn
    rows = [(s, n, 100, s % 7 + n) for s in range(7, 14) for n in (1, 2, 3)] + [(20, 1, 100, 50), (20, 2, 100, 51), (21, 1, 100, 40), (21, 2, 100, 41), (30, 1, 100, 60)]
    got = near_copies._firsts(spark.createDataFrame(rows, "s long, node long, n long, at long"))
    assert {(r["s"], r["node"], r["at"]) for r in got.collect()} == {(7, 1, 1), (7, 2, 2), (7, 3, 3), (21, 1, 40), (21, 2, 41)}


def test_a_passage_that_many_texts_share_is_common_however_many_texts_there_are(spark, monkeypatch):
    # a sample of fixed size saw only passages that a share of all texts have, whose pairs grow as the square
    monkeypatch.setattr(near_copies, "SAMPLE", 16)
    passage = " ".join(f"p{i}" for i in range(9))
    texts = [" ".join(f"own{i}x{k}" for k in range(8)) + (" " + passage if i % 10 == 0 else "") for i in range(3000)]
    common = near_copies._common(spark.createDataFrame([(t,) for t in texts], "text string"))[0]
    assert set(near_copies.shingles(passage)) <= set(common)


def test_texts_that_are_nobodys_copies_are_not_shuffled(spark, monkeypatch):
    # both joins with texts dealt all of them, once the other side was too large for a broadcast
    monkeypatch.setattr(near_copies, "SAMPLE", 8)
    r = np.random.default_rng(7)
    texts = ["".join(f"{r.bytes(40).hex()} " for _ in range(150)) for _ in range(320)]
    texts += [t + "more" for t in texts[:6]] + texts[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(k) for k in range(stages.size()))}

    before, limit = set(shuffled()), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = sorted(x["doc_id"] for x in simhash.keep_one(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert kept == list(range(320))
    assert sum(v for k, v in shuffled().items() if k not in before) < sum(map(len, texts)) / 2


def test_a_bitmap_of_keys_holds_no_row_back(spark):
    rows = spark.range(5000).selectExpr("if(id % 11 = 0, null, id) as id", "id * 7 as h")
    keys = rows.where("id is null or id % 50 = 3").selectExpr("id as d", "h as e")
    through, rest = sketches.thinned(rows, ["id", "h"], keys, ["d", "e"])
    assert keys.count() == through.where("id is null or id % 50 = 3").count()
    assert through.count() < keys.count() + 1000 and through.count() + rest.count() == 5000
    through, rest = sketches.thinned(rows, ["id", "h"], keys.limit(0), ["d", "e"])
    assert through.isEmpty() and rest.count() == 5000
