"""Mixing sources to target weights with soft domain membership.

The labelled table names a domain for some documents (toxic, junk or clean).  A naive Bayes
classifier over the words that speak for a domain and over the shape of the text learns from a sample of them and gives every document
a posterior over the domains.  A document then counts for each domain with its tokens times that posterior.  Wanted are
nonnegative rates under which the expected token shares of the domains match the targets: least squares, solved by
projected gradient steps.  Each step is one distributed aggregate of as many sums as there are domains.

With G the token-weighted second moments of the posteriors, a step is

    rate <- max(0, rate - posterior . solve(G, shares under rate - target)),

the gradient step of length 1 in the metric that whitens the residual and weighs rates by tokens, so documents of one
posterior get one rate whatever their length.  All work is built-in functions; the driver sees K by K sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.labelled import chance, sample, trained
from sluice.llm.scratch import Scratch, fresh

#: Token shares of the domains.
TARGETS = {"clean": 0.90, "toxic": 0.07, "junk": 0.03}
LABELLED, VOCABULARY, APART, PRIOR_ROWS, STEPS, FOLD, CLOSE = 12_000, 256, 60.0, 4, 24, 6, 1e-5


def _words(text: str) -> Column:
    """Words as they are; case matters to the shape of a text."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _tenths(name: str, words: str, holds) -> Column:
    """The share of words that hold something, in tenths (rounded up, so none and some differ), as a sign."""
    share = F.ceil(10 * F.size(F.filter(words, holds)) / F.greatest(F.size(words), F.lit(1)))
    return F.concat(F.lit(f"={name}"), share.cast("string"))


def _read(texts: DataFrame, *others: str) -> DataFrame:
    """``others``, tokens (the number of words), the distinct words of a text, and its shape as signs: tenths of the distinct words
    that end in a mark or are in capitals, and of words that are distinct."""
    words = texts.select(*others, _words("text").alias("words"))
    distinct = words.select(*others, F.size("words").cast("long").alias("tokens"), F.array_distinct("words").alias("distinct"))
    marked = _tenths("marks", "distinct", lambda w: F.ascii(F.right(w, F.lit(1))) < 48)
    capital = _tenths("capitals", "distinct", lambda w: (F.lower(w) != w) & (F.upper(w) == w))
    level = F.concat(F.lit("=distinct"), F.floor(10 * F.size("distinct") / F.greatest(F.col("tokens"), F.lit(1))).cast("string"))
    return distinct.select(*others, "tokens", "distinct", F.array(marked, capital, level).alias("shape"))


def _signs(lists: dict[str, list[str]]) -> Column:
    """A text's shape, and for each domain how many of the words that speak for it the text holds (up to five, or more)."""
    def held(d):
        known = F.lit(lists[d]) if lists[d] else F.array().cast("array<string>")
        return F.concat(F.lit(f"={d}"), F.least(F.size(F.array_intersect("distinct", known)), F.lit(5)).cast("string"))
    return F.concat("shape", F.array(*[held(d) for d in sorted(lists)]))


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled rows that may be learned from: toxic, else junk if of low quality, else clean."""
    q, t = trained(labels, "quality").withColumnRenamed("label", "q"), trained(labels, "toxic").withColumnRenamed("label", "t")
    return q.join(t, "doc_id").select("doc_id", F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "junk").otherwise("clean").alias("domain"))


def _shares(texts: DataFrame, sign: Column, domains: list[str]) -> tuple[DataFrame, list[int]]:
    """(sign, every, p0, p1, ...): the share of all texts, and of each domain's, that hold a sign; the domains' numbers of texts.

    A domain's share leans on that of all texts, as if PRIOR_ROWS more of its texts had it: a rare domain claims little.
    """
    of = {r["domain"]: r["count"] for r in texts.groupBy("domain").count().collect()}
    n, total = [of.get(d, 0) for d in domains], sum(of.values())
    held = texts.select("domain", F.explode(sign).alias("sign")).groupBy("sign").agg(
        *[F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)])
    every = (sum((F.col(f"n{k}") for k in range(1, len(domains))), F.col("n0")) + 0.5) / (total + 1.0)
    return held.select("sign", every.alias("every"), *[
        ((F.col(f"n{k}") + PRIOR_ROWS * every) / (n[k] + PRIOR_ROWS)).alias(f"p{k}") for k in range(len(domains))]), n


def _classifier(docs: DataFrame, labels: DataFrame, domains: list[str], keep: Scratch):
    """The words that speak for each domain, (sign, w: its weight under each domain), and each domain's constant.

    A word speaks for a domain if it is twice as frequent there as anywhere and its shares differ more than chance
    explains (chi-square ``APART``).  How many of them a text holds is one sign, so their number is calibrated, none included.
    """
    chosen = sample(domains_of(labels).where(F.col("domain").isin(domains)), LABELLED, 23)
    texts = keep.keep(_read(docs.join(F.broadcast(chosen), "doc_id"), "domain"))
    words, n = _shares(texts, F.col("distinct"), domains)
    k, total = range(len(domains)), sum(n)
    apart = sum((n[i] * F.pow(F.col(f"p{i}") - F.col("every"), 2) for i in k), F.lit(0.0)) / (F.col("every") * (1 - F.col("every")) + 1.0 / (total + 1))
    words = keep.keep(words.withColumn("apart", apart).where(F.col("apart") > APART))
    lists = {d: [r["sign"] for r in words.where(F.col(f"p{i}") > 2 * F.col("every")).orderBy(F.col("apart").desc(), "sign").limit(VOCABULARY).select("sign").collect()]
             for i, d in enumerate(domains)}
    signs, _ = _shares(texts, _signs(lists), domains)
    base = [float(np.log((x + 0.5) / (total + 1))) for x in n]
    return lists, keep.keep(signs.select("sign", F.array(*[F.log(F.col(f"p{i}") / F.col("every")) for i in k]).alias("w"))), base


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str], keep: Scratch) -> DataFrame:
    """(row, doc_id, tokens, p): each row's word count and its posterior over ``domains``."""
    docs = docs.select("doc_id", "text")
    lists, weights, base = _classifier(docs, labels, domains, keep)
    signs = keep.keep(_read(docs, "doc_id").select("doc_id", "tokens", _signs(lists).alias("signs"), F.monotonically_increasing_id().alias("row")))
    k = range(len(domains))
    sums = signs.select("row", F.explode("signs").alias("sign")).join(F.broadcast(weights), "sign").groupBy("row").agg(
        *[F.sum(F.col("w")[i]).alias(f"s{i}") for i in k])
    scored = signs.select("row", "doc_id", "tokens").join(sums, "row", "left")
    logit = [F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + base[i] for i in k]
    scored = scored.select("row", "doc_id", "tokens", *[x.alias(f"l{i}") for i, x in enumerate(logit)])
    top = F.greatest(*[F.col(f"l{i}") for i in k]) if len(domains) > 1 else F.col("l0")
    scored = scored.withColumn("top", top).withColumn("mass", sum((F.exp(F.col(f"l{i}") - F.col("top")) for i in k), F.lit(0.0)))
    return keep.keep(scored.select("row", "doc_id", "tokens", F.array(*[F.exp(F.col(f"l{i}") - F.col("top")) / F.col("mass") for i in k]).alias("p")))


def _stepped(rate: Column, multipliers: list[list[float]]) -> Column:
    """The rate after projected steps with these multipliers."""
    for m in multipliers:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col("p")[k] * float(x) for k, x in enumerate(m)), F.lit(0.0)))
    return rate


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, tokens, posterior, rate, copies) of each row of ``docs`` (doc_id, text).

    posterior maps a domain to its probability; rate is how often a row should be drawn, copies the whole number drawn: rate
    rounded up or down by a number that depends on the id and the row alone, so copies average the rate.  Targets are
    scaled to sum 1; the total of tokens is kept.  A domain without labelled rows has the prior of half a row and no words of its own.  Null and empty texts have no tokens and
    the rate of their posterior.  An empty table, or one without tokens, leaves rates at 1.  Rows without id are mixed like others and never learned from.
    """
    keep, domains = Scratch(docs.sparkSession, "mixing"), sorted(targets)
    want = np.array([targets[d] for d in domains], dtype=float) / sum(targets.values())
    rows = posteriors(docs, labels, domains, keep).withColumn("rate", F.lit(1.0))
    k = len(domains)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col("p")[i] * F.col("p")[j]) for i, j in pairs]).first()
    total, gram = float(got[0] or 0), np.zeros((k, k))
    steps: list[list[float]] = []
    if total:
        for (i, j), x in zip(pairs, got[1:], strict=True):
            gram[i, j] = gram[j, i] = x / total
        inverse = np.linalg.pinv(gram, rcond=1e-9)
        for _ in range(STEPS):
            rate = _stepped(F.col("rate"), steps)
            share = rows.agg(*[F.sum(F.col("tokens") * rate * F.col("p")[i]) for i in range(k)]).first()
            off = np.array([float(x) for x in share]) / total - want
            if np.abs(off).max() < CLOSE:
                break
            steps.append((inverse @ off).tolist())
            if len(steps) == FOLD:  # keeps expressions short
                rows, steps = keep.keep(rows.withColumn("rate", _stepped(F.col("rate"), steps))), []
    rows = rows.withColumn("rate", _stepped(F.col("rate"), steps))
    drawn = F.floor(F.col("rate") + chance(F.coalesce(F.col("doc_id"), F.col("row")), 31)).cast("int")
    return rows.select("row", "doc_id", "tokens", F.map_from_arrays(F.lit(domains), "p").alias("posterior"), "rate", drawn.alias("copies"))


def draw(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` with each row repeated as often as its rate draws it.

    Rows without id are mixed as one more id; rows that share an id are drawn alike, by the mean of their rates.
    """
    rates = mixing_rates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, targets)
    own, times = fresh("id", docs), fresh("copies", docs)
    copies = rates.groupBy(F.col("doc_id").alias(own)).agg(
        F.floor(F.avg("rate") + chance(F.coalesce("doc_id", F.lit(-1)), 31)).cast("int").alias(times))
    drawn = docs.join(copies, F.col("doc_id").cast("long").eqNullSafe(F.col(own))).where(F.col(times) > 0)
    return drawn.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(fresh("copy", docs))).select(docs.columns)
