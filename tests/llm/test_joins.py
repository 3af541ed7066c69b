"""The joins and the language model against plain Python versions, and on hot groups."""

import math
import random
import time

import numpy as np
import pytest

import brute
import brute_joins
from loomline.llm import line_dedup, lm_scoring, ngram_join
from test_contracts import awkward, pairs, rows, same, structured, table  # noqa: F401


def corpus(seed, n, edits, base=40, vocab=400):
    """Documents of which many are copies of others with some words changed."""
    r, out = random.Random(seed), []
    word = lambda: f"w{int(vocab * r.random() ** 2)}"
    for i in range(n):
        if out and r.random() < 0.7:
            lines = [line.split() for line in r.choice(out)[1].split("\n")]
            for _ in range(r.randint(0, edits)):
                line = r.choice(lines)
                line[r.randrange(len(line))] = word()
        else:
            lines = [[word() for _ in range(r.randint(3, base))] for _ in range(r.randint(1, 4))]
        out.append((i, "\n".join(" ".join(x) for x in lines)))
    return out


@pytest.fixture(scope="session")
def copies(spark):
    return spark.createDataFrame(corpus(5, 220, 6) + [(1000 + i, "a b c d e f g h i j k l m n o p q r s t u v x" + f" y{i}") for i in range(150)], "doc_id long, text string")


@pytest.mark.parametrize("which", ["table", "awkward", "copies", "empty", "structured"])
def test_classes(spark, awkward, copies, structured, which):  # noqa: F811
    docs = {"table": table(spark, "documents"), "awkward": awkward, "copies": copies, "empty": awkward.limit(0), "structured": structured}[which]
    same(rows(ngram_join.classes(docs), "doc_id", "n_shingles", "component_id"), brute_joins.op10(pairs(docs)))


def test_components_of_long_chains(spark):
    r = random.Random(2)
    names = list(range(60))
    r.shuffle(names)
    chain = [(names[i], names[i + 1]) for i in range(40)] + [(names[45], names[46]), (names[46], names[45]), (7, 7)]
    got = {x["sid"]: x["label"] for x in ngram_join.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[x] for x in names[:41]} == {min(names[:41])} and got[names[45]] == min(names[45:47])


@pytest.mark.parametrize("which", ["table", "awkward", "copies", "empty", "structured"])
def test_line_dedup(spark, awkward, copies, structured, which):  # noqa: F811
    docs = {"table": table(spark, "documents"), "awkward": awkward, "copies": copies, "empty": awkward.limit(0), "structured": structured}[which]
    got = line_dedup.find(docs).collect()
    d, th = line_dedup._keys(docs, "doc_id", "text")
    plain = [((r["d"], r["th"]), r["doc_id"], r["text"]) for r in docs.select(d.alias("d"), th.alias("th"), "doc_id", "text").collect()]
    want = brute_joins.op3([(p, t) for p, _, t in plain], lambda row: row[0])
    lines = [sum(bool(brute.space_words(x)) for x in (t or "").split("\n")) for _, _, t in plain]
    assert sorted(((r["doc_id"], r["n_lines"], r["removed"], r["n_removed"]) for r in got), key=repr) == sorted(((p[1], n, w, len(w)) for p, n, w in zip(plain, lines, want, strict=True)), key=repr)


def test_line_dedup_texts(spark):
    line = "the same long line of seven words"
    docs = [(2, f"{line}\nown words here that nobody else has"), (1, f"first\n{line}"), (3, "the same long line of seven words today"), (4, None), (4, "a b\na b")]
    out = {(r["doc_id"], r["text"]) for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").withColumn("removed", line_dedup.F.lit("mine")), min_words=5).collect()}
    assert out == {(2, "own words here that nobody else has"), (1, f"first\n{line}"), (3, ""), (4, None), (4, "a b\na b")}


def test_line_dedup_short_lines(spark):
    short = ["a", "b c", "d e f", "g h i j", "k l m n o", "p q r s t u v w x"]
    docs = [(1, "\n".join(short)), (2, "\n".join([*short[::-1], "y"])), (3, "g h i j z\nd e f z\nl k O n m O\nk l m n y\np q r s t u v w y")]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    # Jaccard 4 / 5 and 8 / 10 match; 3 / 4 and 4 / 6 don't.
    assert got == {1: [], 2: [0, 1, 2, 3, 4, 5], 3: [0, 2, 4]}


def test_line_dedup_with_few_lists(spark, monkeypatch):
    # 256 lists for all pairs of words, so that most lists are long and of unlike lines.
    monkeypatch.setattr(line_dedup, "_LIST_BITS", line_dedup.np.uint64(56))
    r = random.Random(3)
    docs = [(i, " ".join(r.sample([f"f{k}" for k in range(14)], 9))) for i in range(40)]
    docs += [(100 + i, " ".join(f"w{i}x{k}" for k in range(10))) for i in range(9)]
    docs += [(200 + i, f"{docs[40 + i][1]} y{i}") for i in range(9)]
    found = line_dedup.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {x["doc_id"]: x["removed"] for x in found}
    assert [got[200 + i] for i in range(9)] == [[0]] * 9
    assert [got[i] for i, _ in docs] == brute_joins.op3(docs, lambda row: (row[0],))


def test_prefixes_share_a_pair():
    # Sets just as similar as asked, with their differences anywhere in the order.
    r = random.Random(7)
    for _ in range(4000):
        n, m = r.randint(1, 30), r.randint(1, 30)
        o = -(-80 * (n + m) // 180)
        if o > min(n, m) or (n, m) == (o, o):
            continue
        words = list(range(n + m - o))
        r.shuffle(words)
        sets = sorted(words[:n]), sorted(words[n - o :])
        prefixes = []
        for s in sets:
            k = int(line_dedup.prefix_pairs(line_dedup.np.array([len(s)]), line_dedup.np.array([0]), 80)[0])
            prefixes.append(set(list(zip(s, s[1:], strict=False))[:k]))
        assert prefixes[0] & prefixes[1], sets


@pytest.mark.parametrize("which", ["table", "awkward", "empty", "structured"])
def test_lm_scoring(spark, awkward, structured, which):  # noqa: F811
    docs = {"table": table(spark, "documents"), "awkward": awkward, "empty": awkward.limit(0), "structured": structured}[which]
    got = sorted(lm_scoring.score(docs).collect(), key=repr)
    want = sorted(brute_joins.op1_base(pairs(docs)), key=repr)
    assert sorted(map(repr, ((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got))) == sorted(map(repr, ((*w[:5], round(w[5], 6)) for w in want)))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    scores = zip((r["doc_id"] for r in docs.select("doc_id", "text").collect()), brute_joins.op1_score(pairs(docs)), strict=True)
    near = lambda rows: sorted((repr(d), x) for d, x in rows)
    for a, b in zip(near((r["doc_id"], r["score"]) for r in got), near(scores), strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-6), (a, b)
    if which == "table":
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_is_a_distribution(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 3)))) for i in range(300)]
    seen = spark.createDataFrame(docs, "doc_id long, text string")
    # Held-out one-word texts: their first words' probabilities add up to those of all words but the end and the unseen one.
    scores = {}
    for t in ("a", "b", "c", "zz", ""):
        held = next(i for i in range(1000, 2000) if brute_joins.zlib.crc32(str(i).encode()) % 10 == 0)
        one = lm_scoring.score(seen.union(spark.createDataFrame([(held, t)], seen.schema))).where(f"doc_id = {held}").first()
        scores[t] = 10 ** one["score"]
    assert 0 < sum(scores.values()) < 1


def test_weights_follow_held_out_counts(spark):
    # Of bucket 5 the pair estimate fits best, of bucket 2 the word estimate.
    counts = spark.createDataFrame([(5, 16, 8, 1, 1000), (2, 0, 0, 100, 1000)], "bucket long, context long, pair long, word long, n long")
    weights = lm_scoring.learn_weights(counts, 1000, 1e-4)
    assert weights[5][0] > 0.9 and weights[2][1] > 0.9 and weights[0][0] == 0
    assert (weights[3] == weights[2]).all() and (weights[24] == weights[5]).all() and (weights[1] == weights[2]).all()
    assert all(abs(w.sum() - 1) < 1e-9 and (w[1:] > 0).all() for w in weights)


def test_batches_without_tuning_rows(spark):
    docs = [(i, f"a b c w{i}") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    spark.conf.set("spark.loomline.exchange.batchBytes", "1")  # every row is a batch
    try:
        got = {r["doc_id"]: r["score"] for r in lm_scoring.score(df).collect()}
        same(rows(ngram_join.classes(df), "doc_id", "n_shingles", "component_id"), brute_joins.op10(docs))
        assert sorted((r["doc_id"], r["removed"]) for r in line_dedup.find(df).collect()) == sorted(zip(range(12), brute_joins.op3(docs, lambda row: (row[0],)), strict=True))
    finally:
        spark.conf.unset("spark.loomline.exchange.batchBytes")
    assert all(math.isclose(got[i], x, rel_tol=1e-6) for (i, _), x in zip(docs, brute_joins.op1_score(docs), strict=True))


def test_long_lists_are_dealt_out_by_size(spark, monkeypatch):
    # Sets that share rare shingles but aren't similar, of many sizes, with some copies among them.
    monkeypatch.setattr(ngram_join, "LONG_LIST", 3)
    r, common = random.Random(11), " ".join(f"c{k}" for k in range(12))
    docs = [(i, f"{common} " + " ".join(f"w{i}x{k}" for k in range(r.randint(1, 90)))) for i in range(60)]
    docs += [(100 + i, docs[3 * i][1] + " z" * (i % 3)) for i in range(20)]
    same(rows(ngram_join.classes(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_shingles", "component_id"), brute_joins.op10(docs))


def test_a_list_of_many_classes(spark):
    # 1.6 million pairs of different classes in one list, of which 30 may be similar.
    r, n, sets = np.random.default_rng(6), 1800, []
    for i in range(n):
        if 0 < i <= 30:
            sets.append((i, *sets[0][1:]))
            continue
        members = r.integers(0, 1 << 64, 40, np.uint64)
        bits = [int(b[0]) for b in ngram_join.parities(np.sort(members), np.arange(40), np.array([0, 40]))]
        sets.append((i, 40, 1, *bits, bytearray(ngram_join.sketch(members))))
    sets = spark.createDataFrame(sets, "sid long, n long, need int, b0 long, b1 long, b2 long, b3 long, sketch binary")
    live = sets.selectExpr("7L AS token", "*", "sid AS label", f"{n}L AS size").drop("sketch")
    began = time.time()
    got = ngram_join._across(live, sets, 85).collect()
    assert time.time() - began < 30
    assert sorted((p["a"], p["b"], p["shared"]) for p in got) == [(a, b, 1) for a in range(31) for b in range(a + 1, 31)]


def test_smallest_sets_match_equal_ones_only(spark):
    # Of n shingles and n + 1 in all 100 n are at least 85 (n + 1) from n = 6 on.
    texts = {k: [" ".join(f"x{k}w{i}" for i in range(k + 3 + more)) for more in (0, 0, 1)] for k in range(1, 10)}
    docs = spark.createDataFrame([(10 * k + i, t) for k, some in texts.items() for i, t in enumerate(some)], "doc_id long, text string")
    got = {p["doc_id"]: p["component_id"] for p in ngram_join.classes(docs).collect()}
    assert got == {10 * k + i: 10 * k + (2 if i == 2 and k < 6 else 0) for k in texts for i in range(3)}


def test_sketches_bound_differences():
    import numpy as np

    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (3, 200, 300, 900, 5000, 70000)]
    sets += [np.r_[s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, 5, dtype=np.uint64)] for s in sets]
    sketches = [ngram_join.sketch(s) for s in sets]
    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    for i, j, n in zip(a, b, ngram_join.differing(a, b, sketches), strict=True):
        assert n <= len(np.setxor1d(sets[i], sets[j])) and (i != j or n == 0)
    assert ngram_join.differing(np.array([4]), np.array([5]), sketches)[0] > 1000
