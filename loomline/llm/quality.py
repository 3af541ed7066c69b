"""Quality rules with DataFrame functions only.

Rules on the text alone are in-row expressions.  The cross-document rule hashes each
normalised line, counts the distinct documents of each host that have it, takes lines in
too many of a host's documents for boilerplate, and rejects documents of which too little
is left without them.  Exact copies are documents as others, but a line must also be in
several different texts of the host, so that a group of copies isn't its own boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .exchange import landed

#: A line is boilerplate if more than so many different texts of a host, and more than this share of its documents, have it.
MAX_TEXTS, MAX_SHARE = 20, 0.05
#: A document is rejected if fewer words, or a smaller share of its words, are left.
MIN_WORDS, MIN_LEFT = 20, 0.5
MAX_REPEAT_PERCENT, REPEAT_WINDOW = 30, 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is evaluated once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of characters other than the six ASCII white spaces; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def repeated_words(of: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words inside runs of window words that occur twice or more in the array."""

    def places(hashes: Column) -> Column:
        paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(s: Column) -> Column:
            last = F.size(s) - 1

            def mark(e: Column, i: Column) -> Column:
                before = (i > 0) & (F.get(s, i - 1)["h"] == e["h"])
                after = (i < last) & (F.get(s, i + 1)["h"] == e["h"])
                return F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), e["i"])

            return F.sort_array(F.filter(F.transform(s, mark), lambda x: x.isNotNull()))

        return _let(paired, same)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda v, j: F.when(j == 0, F.lit(window)).otherwise(F.least(F.lit(window), v - F.get(p, j - 1))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(places(hashes), covered))

    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))

    hashed = F.transform(of, lambda w: F.xxhash64(w))
    return F.when(F.size(of) > window, _let(_let(hashed, runs), count)).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; older columns of these names go."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    out = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = out.withColumns(
        {
            "__words__": _let(words(F.col(text)), of_words),
            "n_symbols": F.length(F.regexp_replace(value, "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    out = out.select("*", "__words__.*").drop("__words__")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """A row for each line with words: the document's key, the line's place, its hash after normalising, and its words."""
    value = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    counted = F.transform(F.split(value, "\n"), lambda x: _let(words(x), lambda w: F.struct(F.xxhash64(F.array_join(w, " ")).alias("line"), F.size(w).cast("long").alias("n"))))
    return docs.select("__id__", "__host__", "__text__", F.posexplode(counted).alias("at", "x")).where("x.n > 0").select("__id__", "__host__", "__text__", "at", "x.line", "x.n")


def boilerplate(docs: DataFrame, text: str, max_texts: int, max_share: float) -> DataFrame:
    """__host__ and line of the lines that too many documents of a host have.

    Every document gives each of its lines once.  Counted by partial sums over (host,
    line, text), then over (host, line), so neither a hot host nor a line on every page
    gathers in a task.
    """
    value = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    hashed = F.transform(F.split(value, "\n"), lambda x: F.array_join(words(x), " "))
    once = F.array_distinct(F.transform(F.filter(hashed, lambda x: x != ""), lambda x: F.xxhash64(x)))
    lines = docs.select("__host__", "__text__", F.explode(once).alias("line"))
    texts = lines.groupBy("__host__", "line", "__text__").agg(F.count("*").alias("n_docs")).groupBy("__host__", "line").agg(F.count("*").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    often = texts.where(F.col("n_texts") > max_texts)
    hosts = docs.groupBy("__host__").agg(F.count("*").alias("n_host"))
    return often.join(hosts, "__host__").where(F.col("n_docs") > F.col("n_host") * max_share).select("__host__", "line")


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    host: str = "source",
    text: str = "text",
    max_texts: int = MAX_TEXTS,
    max_share: float = MAX_SHARE,
    min_words: int = MIN_WORDS,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """docs with the features, words_left (without boilerplate lines) and kept.

    Every row counts as a document of its host; copies of one text are one text, so
    copies alone never make their lines boilerplate.  A null host is a host of its own, the empty one; a null text is
    empty and fails.  Equal rows get equal results; rows that share an id but differ
    in host or text are judged apart.
    """
    keyed = {"__id__": F.col(doc_id), "__host__": F.coalesce(F.col(host), F.lit("")), "__text__": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}
    slim = docs.select(*(v.alias(k) for k, v in keyed.items()), F.col(text))
    lines = _lines(slim, text)
    bad = landed(boilerplate(slim, text, max_texts, max_share))
    bad = bad.select(F.xxhash64("__host__", "line").alias("k"))
    hit = lines.withColumn("k", F.xxhash64("__host__", "line")).join(bad, "k", "left_semi")
    # Repeated rows give the same lines at the same places, which count once.
    hit = hit.select("__id__", "__host__", "__text__", "at", "n").distinct()
    gone = hit.groupBy("__id__", "__host__", "__text__").agg(F.sum("n").alias("__gone__"))
    same = [F.col("__id__").eqNullSafe(F.col("__gi__")), F.col("__host__") == F.col("__gh__"), F.col("__text__") == F.col("__gt__")]
    gone = gone.select(F.col("__id__").alias("__gi__"), F.col("__host__").alias("__gh__"), F.col("__text__").alias("__gt__"), "__gone__")
    out = features(docs, text).drop("words_left", "kept").withColumns(keyed).join(gone, same, "left")
    out = out.withColumn("words_left", F.col("n_words") - F.coalesce("__gone__", F.lit(0))).drop("__id__", "__host__", "__text__", "__gi__", "__gh__", "__gt__", "__gone__")
    depleted = (F.col("words_left") < min_words) | (F.col("words_left") < F.col("n_words") * min_left)
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)
