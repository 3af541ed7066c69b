"""URL filters: host and path rules, and character language models for what no rule fits.

DataFrame functions only.  URLs that a rule allows or blocks train one Markov model of
each kind over a fixed alphabet; the models have variable order: each order is
smoothed with the next lower one by the number of different characters that follow its
context.  A URL that no rule fits is judged by the difference of its log likelihoods
per character, against a threshold calibrated on the labelled URLs that training left
out.

The alphabet bounds the model: with 41 symbols there are at most 41 ** 4 runs of four,
however large the corpus is.  A table of the model is broadcast if it has been counted to
have BROADCAST_ROWS at most; larger ones are joined by shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .exchange import landed

#: (rule, verdict); the longest rule that fits wins.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
ORDER = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The alphabet: a-z, one digit sign, these marks, "~" for any other character; "^" and "$" are the ends.
_MARKS = r"\-./:?=&_#%+"
_BIN = 0.02
#: A row of the model takes some 100 bytes, so a broadcast table has 30 MB at most.
BROADCAST_ROWS = 300_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty if it's null or has no "://"."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    value = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(value, pattern, 1), _UPPER, _LOWER), F.regexp_extract(value, pattern, 2)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def signs(url: Column) -> Column:
    """A URL in the alphabet: scheme dropped, lower case, digits as "0", three "^" before and a "$" after."""
    text = F.translate(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""), _UPPER, _LOWER)
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), f"[^a-z0{_MARKS}]", "~")
    return F.concat(F.lit("^" * ORDER), text, F.lit("$"))


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of signs, with it and the ORDER characters before it as gram."""
    return urls.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("signs") - ORDER), lambda i: F.substring(F.col("signs"), i, F.lit(ORDER + 1)))).alias("gram"))


def _sent(table: DataFrame, rows: int) -> DataFrame:
    """table, to be broadcast if it's known to have few rows."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def model(train: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram and ratio, the difference of the log likelihoods of its last character, for all wanted grams.

    train: gram, label.  P_k(c | context) = (n(context c) + t(context) P_(k-1)(c)) / (n(context) + t(context)),
    t: the different characters seen after the context; P_0 is uniform over the alphabet.
    """
    sizes = 26 + 1 + len(_MARKS.replace("\\-", "-")) + 2
    counts = landed(train.groupBy("gram").agg(*(F.count(F.when(F.col("label") == w, 1)).alias(w) for w in ("allow", "block"))))
    most = counts.count()  # no order has more runs than the highest
    out = wanted.select("gram").distinct().withColumns({w: F.lit(1.0 / sizes) for w in ("p_allow", "p_block")})
    for k in range(ORDER + 1):
        part = counts.groupBy(F.substring(F.col("gram"), ORDER + 1 - k, k + 1).alias("g")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = part.groupBy(F.substring(F.col("g"), 1, k).alias("c")).agg(
            *(F.sum(w).alias(f"n_{w}") for w in ("allow", "block")), *(F.count(F.when(F.col(w) > 0, 1)).alias(f"t_{w}") for w in ("allow", "block"))
        )
        out = out.join(_sent(part, most), F.substring(F.col("gram"), ORDER + 1 - k, k + 1) == F.col("g"), "left")
        out = out.join(_sent(context, most), F.substring(F.col("gram"), ORDER + 1 - k, k) == F.col("c"), "left")
        mixed = {}
        for w in ("allow", "block"):
            n, t, c = (F.coalesce(F.col(x), F.lit(0)) for x in (f"n_{w}", f"t_{w}", w))
            mixed[f"p_{w}"] = F.when(n + t > 0, (c + t * F.col(f"p_{w}")) / (n + t)).otherwise(F.col(f"p_{w}"))
        out = out.withColumns(mixed).select("gram", "p_allow", "p_block")
    return out.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The score from which allowing makes the fewest errors, each label weighing the same; 0 without both labels.

    scored: score, label.  Scores are counted in bins of 0.02 between -4 and 4, so at
    most 401 rows reach the driver; of equally good bins' edges the middle one counts.
    """
    edge = int(4 / _BIN)
    binned = F.greatest(F.lit(-edge), F.least(F.lit(edge), F.floor(F.col("score") / _BIN))).cast("int")
    rows = {r["b"]: (r["a"], r["k"]) for r in scored.groupBy(binned.alias("b")).agg(F.count(F.when(F.col("label") == "allow", 1)).alias("a"), F.count(F.when(F.col("label") == "block", 1)).alias("k")).collect()}
    allowed, blocked = sum(a for a, _ in rows.values()), sum(k for _, k in rows.values())
    if not allowed or not blocked:
        return 0.0
    best, found = None, []
    for b in range(-edge, edge + 2):  # allow from bin b on
        wrong = sum(a for x, (a, _) in rows.items() if x < b) / allowed + sum(k for x, (_, k) in rows.items() if x >= b) / blocked
        if best is None or wrong < best - 1e-12:
            best, found = wrong, [b]
        elif wrong <= best + 1e-12:
            found.append(b)
    return found[len(found) // 2] * _BIN


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule fits) of every row.

    Labelled URLs calibrate if the first byte of their SHA-256 is divisible by 5; the
    others train.  Without
    URLs of both labels the score is 0 and such URLs are allowed; a null URL is judged
    as an empty one.  Rows that share id and URL get equal results.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, label = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "label": label})
    used = rows.select("url", "label", signs(F.col("url")).alias("signs"))
    held = F.conv(F.substring(F.sha2("url", 256), 1, 2), 16, 10).cast("int") % 5 == 0
    train = used.where(F.col("label").isNotNull() & ~held)
    found = train.groupBy("label").count().collect()
    if len(found) < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("label", F.lit("allow")).alias("verdict"), F.when(F.col("label").isNull(), F.lit(0.0)).alias("score"))
    asked = used.where(F.col("label").isNull() | held).groupBy("url").agg(F.first("signs").alias("signs"), F.first("label").alias("label"))
    ratios = landed(model(grams(train, "label"), grams(asked)))
    score = grams(asked, "url", "label").join(_sent(ratios, ratios.count()), "gram").groupBy("url", "label")
    score = landed(score.agg((F.sum(F.col("ratio").cast("decimal(28,12)")).cast("double") / F.count("*")).alias("score")))
    limit = threshold(score.where(F.col("label").isNotNull()))
    mine = score.where(F.col("label").isNull()).select(F.xxhash64("url").alias("k"), F.col("url").alias("scored_url"), "score")
    out = rows.join(mine, F.col("label").isNull() & (F.xxhash64(F.col("url")) == F.col("k")) & (F.col("url") == F.col("scored_url")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", F.when(F.col("score") >= limit, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"), "score")
