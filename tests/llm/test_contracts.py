"""The queries against plain Python versions, on the smallest tables and on awkward rows."""

import public_tokenizers as P
import pytest

import brute
from loomline.llm import bpe, decontam, line_dedup, lm_scoring, ngram_join, quality, queries, token_counts, token_store, warc

SF = "/root/testdata/sf0.001"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
AWKWARD = [
    (1, None, "en", None, 0),
    (2, "", "en", "a", 0),
    (3, "word", "en", "a", 4),
    (3, "word", "en", "a", 4),
    (4, "  spaces  only\n\n\t\x0b end'll don't  　x 12ab ", None, "a", 9),
    (5, f"Before {PASSAGE} after. {PASSAGE}\n{PASSAGE}", "en", "b", 9),
    (None, "no id here " * 30, "en", "b", 9),
    (6, "long " * 30000 + "é漢字😀" * 500, "en", "b", None),
    (7, "# * $ % & | < >\n# * $ % & | < >\n\n \n x", "en", "b", 9),
    (8, "one two three four five six seven eight nine ten eleven twelve thirteen", "en", "b", 9),
    (9, "a b c d e f g h " * 4 + "z", "en", "b", 9),
]


def long_words():
    """Words of 1 to 4 KB of two letters in self-similar orders, which sums of powers can't tell apart, and others that differ in one place."""
    order = [bin(k).count("1") % 2 for k in range(4096)]
    out = []
    for n in (1024, 2048, 4096):
        out += ["".join("ab"[x] for x in order[:n]), "".join("ba"[x] for x in order[:n])]
        out.append(out[-1][:700] + ("a" if out[-1][700] == "b" else "b") + out[-1][701:])
    return out


@pytest.fixture(scope="session")
def structured(spark):
    words = long_words()
    docs = [(i, f"{w} and {words[i - 1]}  {w}\n{w} one two three") for i, w in enumerate(words)]
    return spark.createDataFrame(docs + [(50, docs[0][1]), (51, docs[1][1] + " more")], "doc_id long, text string")


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def pairs(df, a="doc_id", b="text"):
    return [(r[a], r[b]) for r in df.select(a, b).collect()]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("which", ["table", "awkward", "empty", "structured"])
def test_byte_bpe(spark, awkward, structured, which):
    docs = {"table": table(spark, "documents"), "awkward": awkward, "empty": awkward.limit(0), "structured": structured}[which]
    same(rows(bpe.round_trip_digests(docs, P.path("byte_bpe_50k.tiktoken")), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), brute.op6(pairs(docs)))


@pytest.mark.parametrize("which", ["table", "awkward", "empty", "structured"])
def test_token_store(spark, awkward, structured, which):
    docs = {"table": table(spark, "documents"), "awkward": awkward, "empty": awkward.limit(0), "structured": structured}[which]
    same(rows(token_store.store_and_read(docs, P.path("byte_bpe_50k.json")), "doc_id", "start", "n_tokens", "ids_crc32"), brute.op2(pairs(docs)))


def test_token_store_added_tokens(spark):
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"{end}{end} x  {end}  y ", "", None, "<|endoftext| >", f"<|{end}|>\n \n{end}", "plain  text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(token_store.store_and_read(docs, P.path("byte_bpe_50k.json")), "doc_id", "start", "n_tokens", "ids_crc32")
    same(got, brute.op2(pairs(docs)))
    assert [n for i, _, n, _ in sorted(got)][:2] == [4, 2]


def test_token_file_random_access():
    import numpy as np

    rng = np.random.default_rng(3)
    ids = np.r_[rng.integers(0, 300, 5000), rng.integers(0, 1 << 31, 700), [0, 1, (1 << 32) - 1]].astype("u4")
    rng.shuffle(ids)
    f = token_store.TokenFile(token_store.encode_file(np.array([5, 6]), np.array([True, False]), np.array([0, 100, len(ids)]), ids))
    at = rng.integers(0, len(ids), 2000)
    assert (f.get(at) == ids[at]).all() and (f.document(1) == ids[100:]).all()
    assert f.known.tolist() == [True, False]


@pytest.mark.parametrize("which", ["table", "awkward", "empty", "structured"])
def test_decontamination(spark, awkward, structured, which):
    docs = {"table": table(spark, "documents"), "awkward": awkward, "empty": awkward.limit(0), "structured": structured}[which]
    extra = spark.createDataFrame([(900, PASSAGE), (901, "Seven Eight, nine"), (902, ""), (None, "word"), (903, None), (904, PASSAGE), (905, long_words()[0]), (906, f"{long_words()[3]} and"), (9, "a b c d e f g h a b c d e f g h a b")], "item_id long, text string")
    items = table(spark, "benchmark").unionByName(extra)
    got = rows(decontam.contamination(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same(got, brute.op5(pairs(docs), pairs(items, "item_id")))


def test_decontamination_in_blocks(spark, awkward, monkeypatch):
    items = table(spark, "benchmark")
    monkeypatch.setattr(decontam, "QUERY_BLOCK_BYTES", 2500)
    docs = table(spark, "documents").unionByName(awkward)
    got = rows(decontam.contamination(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same(got, brute.op5(pairs(docs), pairs(items, "item_id")))
    assert not any(r[5] for r in rows(decontam.contamination(docs, items.limit(0)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))


@pytest.mark.parametrize("which", ["table", "awkward", "empty"])
def test_warc(spark, which):
    page = "<html>" + "x" * 200
    odd = [(1, "http://a\r\nb/", page), (2, None, page), (2, None, page), (None, "u", page), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (0, "é", "\r\n\r\nContent-Length: 9\r\n\r\n" * 9), (7, "u", "é" * 70000)]
    made = spark.createDataFrame(odd, "page_id long, url string, html string")
    pages = {"table": table(spark, "pages"), "awkward": made, "empty": made.limit(0)}[which]
    got = rows(warc.archive_and_read(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    same(got, brute.op7(pairs(pages, "page_id", "html")))


def test_warc_lookup(tmp_path):
    made = [(f"urn:page:{i}", warc.record(i, "http://x/", bytes([65 + i]) * 100, "d", None, "1970-01-01T00:00:00Z")) for i in range(20)]
    path = f"file://{tmp_path}/a.warc.zst"
    warc.write_file(path, warc.bundle(made, frame_bytes=1000))
    places, index = warc.frames(path)
    assert len(places) > 5 and len(index) == 20
    head, body = warc.lookup(path, "urn:page:7")
    assert head["WARC-Record-ID"] == "<urn:page:7>" and body.endswith(b"H" * 100)


@pytest.mark.parametrize("which", ["table", "awkward", "empty", "structured"])
def test_token_counts(spark, awkward, structured, which):
    docs = {"table": table(spark, "documents"), "awkward": awkward, "empty": awkward.limit(0), "structured": structured}[which]
    path = P.path("word_bpe_49k.json")
    same(rows(token_counts.count(docs.select("doc_id", "text"), path, keep=["doc_id"]), "doc_id", "n_words", "n_pieces"), brute.op8(pairs(docs), token_counts.vocabulary(path)))


def test_automaton_pops_failed_paths():
    import numpy as np

    vocab = [tuple(b"ab"), tuple(b"abcd"), tuple(b"bcde"), (*b"e", 256), tuple(b"abcdefg")]
    machine = token_counts.Automaton(vocab)
    for word in (b"abcde", b"abcdef", b"abcdefg", b"bcd", b"aab", b"e", b"xyz", b"abcdeabcdee"):
        data = np.frombuffer(word, np.uint8)
        assert machine.counts(data, np.array([0]), np.array([len(word)]))[0] == brute.pieces(word, set(vocab)), word


@pytest.mark.parametrize("which", ["table", "awkward", "empty"])
def test_quality(spark, awkward, which):
    docs = {"table": table(spark, "documents"), "awkward": awkward, "empty": awkward.limit(0)}[which]
    got = rows(quality.judge(docs, max_texts=2, max_share=0.3), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    plain = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    base, kept = brute.op9_base([(d[0], d[2]) for d in plain]), brute.op9_kept(plain, 2, 0.3)
    same(got, [(*b, k) for b, k in zip(base, kept, strict=True)])


def test_quality_rejects_depleted(spark):
    shared = " ".join(f"menu{i}" for i in range(30))
    body = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    docs = [(i, f"{shared}\n{body(i, 5)}", "h") for i in range(6)] + [(10, f"{shared}\n{body(10, 90)}", "h"), (11, f"{shared}\n{body(11, 5)}", "g"), (12, f"{shared}\n{body(0, 5)}", "h")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df, max_texts=3, max_share=0.1).collect()}
    assert [i for i, k in kept.items() if k] and kept[10] and kept[11] and not kept[0] and not kept[12]
    assert [k for _, k in sorted(kept.items())] == [x for _, x in sorted(zip([d[0] for d in docs], brute.op9_kept([(d[0], d[2], d[1]) for d in docs], 3, 0.1), strict=True))]


def test_quality_plan_is_native(spark):
    plan = quality.judge(table(spark, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_are_told_apart_by_bytes(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    words = bpe.Words(pa.array(["a b a", None, "c b"]))
    data = words.data.tobytes()
    assert [data[s:e] for s, e in zip(words.starts, words.ends, strict=True)] == [b"a", b" b", b" a", b"c", b" b"]
    assert len(words.keys) == 4 and words.place[1] == words.place[4] and len(set(words.place.tolist())) == 4
    known, raw, one = token_store._Known(), np.frombuffer(b"abcdef", np.uint8), np.array([1])
    known.add(np.array([5], np.uint64), b"ab", np.array([2]), np.array([7], "<u4"), one)
    at = lambda start, n: known.find(np.array([5], np.uint64), raw, np.array([start]), np.array([n]))[0]
    assert (at(0, 2), at(2, 2), at(0, 3)) == (0, -1, -1)


def test_columns_with_clashing_names(spark, awkward):
    names = ("ids", "decoded", "n_words", "hit_spans", "n_pieces", "kept", "words_left", "gone", "k", "fold", "score", "start", "d", "th", "line", "n_lines", "removed", "target", "batch", "part", "payload", "n", "set_key", "token", "tokens", "label", "component_id", "class", "again_id", "refers_to", "path")
    odd = awkward.withColumns({c: awkward["lang"] for c in names})
    for op in (lm_scoring.score, line_dedup.find, line_dedup.dedup, ngram_join.classes):
        assert op(odd).count() == len(AWKWARD), op
    same(sorted(repr(r["removed"]) for r in line_dedup.dedup(odd).collect()), [repr(r[2]) for r in AWKWARD])
    assert token_store.store_and_read(odd, P.path("byte_bpe_50k.json")).count() == len(AWKWARD)
    assert warc.archive_and_read(odd.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})).count() == len(AWKWARD)
    assert bpe.encode(odd, "text", P.path("byte_bpe_50k.tiktoken")).count() == len(AWKWARD)
    assert decontam.mark(odd, table(spark, "benchmark")).count() == len(AWKWARD)
    assert token_counts.count(odd, P.path("word_bpe_49k.json")).count() == len(AWKWARD)
    assert quality.judge(odd).count() == len(AWKWARD)


def test_queries_are_registered():
    assert all(name.startswith("op") for name in queries.QUERIES) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
