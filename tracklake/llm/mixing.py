"""Soft-membership mixing of texts towards target weights of domains.

A naive Bayes classifier over hashed words, counted on a labelled table, gives
each text its posteriors over the domains; the priors are the labelled counts.
Words of a text depend on each other, so the evidence is divided by a power of
the text's length, the one with the least log loss on the half of the labelled
rows that the weights it is tried with have not seen.  Each text then gets a
rate (its expected number of copies), by projected least squares: the expected
token totals of the domains, sum of rate * tokens * posterior, are drawn to
their targets while a rate below its floor is set to the floor.  Gradient
steps are scaled by the inverse Gram matrix and go on until every domain's
miss is below TOLERANCE; a fit that can't get there warns, and returns the
shares that it has.  A step needs only totals of the domains, one small
aggregate over all texts.

Everything is DataFrame functions.  A rate is realised as its whole part, and
one copy more for a hash of the id below the rest.

Results for odd input: a null or empty text has no tokens, the priors as its
posteriors and the rate that they give; a null ``doc_id`` stays null; repeated
rows get equal rates; labels that are null or outside the targets are left out
of the fit, and without any label the posteriors are uniform; an empty table
gives an empty result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed, materialise, row_key

BUCKETS = 4096
KEY = ["doc_id", "text_low", "text_high"]
#: Powers of the length that are tried on held-out texts.
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)
#: At most so many labelled rows, those with the smallest hashes of their ids, are counted.
SAMPLE = 20_000
#: Target share of tokens by domain.
TARGETS = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}
#: Newton steps at most; a fit that has not met its targets by then is reported.
STEPS = 24
#: Largest miss of a domain, as a part of all tokens after the fit.
TOLERANCE = 1e-4
#: Weight of the rates' distance from 1 against the squared misses.
RIDGE = 1e-7


def _words(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def labelled_texts(labelled: DataFrame, domains: list[str]) -> DataFrame:
    """text_id, half (0 or 1), domain (its place) and text of the labelled texts of these domains.

    The halves go by a hash of the text, so that equal texts are in one.
    """
    place = F.lit(None).cast("int")
    for i, d in enumerate(domains):
        place = F.when(F.col("domain") == d, i).otherwise(place)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return labelled.where(F.col("domain").isin(domains)).select(
        F.monotonically_increasing_id().alias("text_id"), F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half"), place.alias("domain"), text.alias("text"),
    )


def _listed(texts: DataFrame, *columns: str) -> DataFrame:
    """The columns, and the bucket of each word of ``text``; a text without words stands once, with none."""
    words = texts.select(*columns, F.explode_outer(_words()).alias("word"))
    return words.select(*columns, F.when(F.col("word").isNotNull(), _bucket(F.col("word"))).alias("bucket"))


def weights(counts: DataFrame, n: int) -> DataFrame:
    """bucket and, per domain, the log probability of its words: BUCKETS rows.

    ``counts``: domain, bucket, n.  Unseen buckets get the smoothed probability.
    """
    counted = counts.where("bucket is not null").groupBy("bucket").agg(*(F.sum(F.when(F.col("domain") == i, F.col("n")).otherwise(0)).alias(f"_n{i}") for i in range(n)))
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counted, "bucket", "left").na.fill(0)
    totals = filled.agg(*(F.sum(f"_n{i}") for i in range(n))).first()
    return filled.select("bucket", *(F.log((F.col(f"_n{i}") + 1) / (totals[i] + BUCKETS)).alias(f"w{i}") for i in range(n)))


def _evidence(words: DataFrame, weight: DataFrame, by: list[str], n: int) -> DataFrame:
    """by, n_tokens and s0, s1, ...: the sums of the log probabilities of a text's words."""
    scored = words.join(F.broadcast(weight), "bucket", "left")
    return scored.groupBy(*by).agg(F.count("bucket").alias("n_tokens"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(n)))


def _softmax(priors: list[float], power: float) -> list[Column]:
    """The posteriors from n_tokens and s0, s1, ..."""
    n = len(priors)
    scale = F.pow(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"), F.lit(power))
    logits = [F.col(f"s{i}") / scale + math.log(p) for i, p in enumerate(priors)]
    top = F.greatest(*logits) if n > 1 else logits[0]
    raised = [F.exp(x - top) for x in logits]
    total = sum(raised[1:], raised[0])
    return [x / total for x in raised]


@dataclass
class Classifier:
    """Log probabilities by bucket, priors, and the power of the length that divides the evidence."""

    weight: DataFrame
    priors: list[float]
    power: float
    #: Mean log loss on held-out labelled texts, by power.
    losses: dict[float, float]


def train(labelled: DataFrame, domains: list[str]) -> Classifier:
    """``labelled``: text, domain.  Priors are the labelled counts (half a text for a domain without any)."""
    n = len(domains)
    # as many rows as were labelled, at most their documented number
    texts = materialise(labelled_texts(labelled, domains), "labelled")
    found = {r["domain"]: r["n"] for r in texts.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = [max(found.get(i, 0), 0.5) for i in range(n)]
    priors = [c / sum(seen) for c in seen]
    counts = materialise(_listed(texts, "half", "domain").groupBy("half", "domain", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    held = _evidence(_listed(texts.where("half = 1"), "text_id", "domain"), weights(counts.where("half = 0"), n), ["text_id", "domain"], n)
    loss = [F.avg(-F.log(F.greatest(F.get(F.array(*_softmax(priors, p)), F.col("domain")), F.lit(1e-300)))) for p in POWERS]
    row = held.agg(*loss).first()
    losses = {} if row[0] is None else dict(zip(POWERS, row, strict=True))
    power = min(losses, key=lambda p: (losses[p], -p), default=0.5)
    weight = materialise(weights(counts, n), "weights")
    discard(texts, counts)
    return Classifier(weight, priors, power, losses)


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, text_low, text_high, n_tokens and p0, p1, ... of every row.

    Words are counted in the task that reads the text: the partial sums of a
    text meet before the shuffle, which carries one row for each.
    """
    n = len(model.priors)
    # a number for each row, so that repeated ids stay apart; used within one stage
    rows = keyed(docs).withColumn("row", F.monotonically_increasing_id())
    sums = _evidence(_listed(rows, "row", *KEY), model.weight, ["row", *KEY], n)
    return sums.select(*KEY, "n_tokens", *(p.alias(f"p{i}") for i, p in enumerate(_softmax(model.priors, model.power))))


def rate_expression(pull: list[float], least: float, shares: list[float] | None = None) -> Column:
    """The rate for these multipliers of the domains, not below its floor.

    With ``shares``, a multiplier counts by how far the posterior is above its share.
    """
    above = shares or [0.0] * len(pull)
    rate = F.lit(1.0)
    for i, (x, share) in enumerate(zip(pull, above, strict=True)):
        rate = rate + F.lit(float(x)) * (F.col(f"p{i}") - F.lit(share))
    return F.greatest(F.lit(float(least)), rate)


def _solve(members: DataFrame, target: list[float], scale: float, least: float, steps: int, shares: list[float] | None = None) -> tuple[list[float], list[float], bool]:
    """(multipliers, token totals of the domains, whether the misses are within TOLERANCE).

    Newton's method with halved steps on the dual of the least squares, which
    is convex and differentiable: its gradient is the misses, its second
    derivative the Gram matrix of the texts above their floor.  A step that
    goes down is one aggregate over all texts.
    """
    n = len(target)
    tokens = F.col("n_tokens").cast("double")
    above = shares or [0.0] * n
    v = [F.col(f"p{i}") - F.lit(above[i]) for i in range(n)]

    def look(pull: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, list[float]]:
        rate = rate_expression(pull.tolist(), least, shares)
        force = sum((F.lit(float(pull[i])) * v[i] for i in range(n)), F.lit(0.0))
        free = F.when(1 + force >= least, tokens).otherwise(0.0)
        row = members.agg(
            F.sum(tokens * (rate * force - (rate - 1) * (rate - 1) / 2)),
            *(F.sum(tokens * rate * F.col(f"p{i}")) for i in range(n)),
            *(F.sum(free * v[i] * v[j]) for i in range(n) for j in range(i, n)),
        ).first()
        found = [x or 0.0 for x in row]
        totals = found[1: n + 1]
        gram = np.zeros((n, n))
        gram[np.triu_indices(n)] = found[n + 1:]
        gram = (gram + np.triu(gram, 1).T) / scale + RIDGE * np.eye(n)
        miss = (np.array(totals) - sum(totals) * np.array(above) - np.array(target)) / scale
        value = found[0] / scale - float(pull @ np.array(target)) / scale + RIDGE / 2 * float(pull @ pull)
        return value, miss, gram, totals

    pull = np.zeros(n)
    value, miss, gram, totals = look(pull)
    for _ in range(steps):
        if np.abs(miss).max() < TOLERANCE:
            return pull.tolist(), totals, True
        slope = miss + RIDGE * pull
        move = -np.linalg.solve(gram, slope)
        if float(-slope @ move) < 1e-15:
            break
        part = 1.0
        while part > 1e-6:
            tried = look(pull + part * move)
            if tried[0] <= value + 1e-4 * part * float(slope @ move):
                break
            part /= 2
        else:
            break
        pull = pull + part * move
        value, miss, gram, totals = tried
    return pull.tolist(), totals, bool(np.abs(miss).max() < TOLERANCE)


def fit_rates(members: DataFrame, shares: list[float], least: float = 0.0, steps: int = STEPS) -> tuple[Column, list[float], bool]:
    """(rate of each text, expected share of each domain, whether they meet ``shares``).

    Least squares over the misses of the domains' token totals, and among
    the rates that reach them those nearest to 1.  The total is the least that
    reaches the targets without lowering any domain; if the floor makes that
    impossible, as every text counts a little for the largest domain, it is free.
    Targets outside of what the posteriors span are not met: the rates are
    then the nearest of the first total.
    """
    n = len(shares)
    tokens = F.col("n_tokens").cast("double")
    now = members.agg(*(F.sum(tokens * F.col(f"p{i}")) for i in range(n))).first()
    totals = [x or 0.0 for x in now]
    known = [i for i in range(n) if totals[i] > 0]
    if not known:
        return F.greatest(F.lit(1.0), F.lit(float(least))), [0.0] * n, True
    goal = max(totals[i] / shares[i] for i in known)
    target = [shares[i] * goal if i in known else 0.0 for i in range(n)]
    pull, found, met = _solve(members, target, goal, least, steps)
    rate = rate_expression(pull, least)
    if not met and least > 0 and len(known) == n:
        free, reached, met = _solve(members, [0.0] * n, sum(totals), least, steps, shares)
        if met:
            rate, found = rate_expression(free, least, shares), reached
    whole = sum(found)
    return rate, [t / whole for t in found], met and len(known) == n


def copies(rate: Column, doc_id: Column) -> Column:
    """The rate's whole part, and one more for ids whose hash falls below the rest."""
    chance = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1_000_000)) / F.lit(1e6)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("long")


@dataclass
class Mixture:
    """What mixing gives: rates by row, and how near they come to the targets."""

    #: doc_id, n_tokens, p_<domain>..., rate, copies, text_low and text_high of every row.
    rows: DataFrame
    #: Expected share of tokens by domain.
    shares: dict[str, float]
    #: Whether every share is within TOLERANCE of its target.
    met: bool


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, least: float = 0.0, steps: int = STEPS) -> Mixture:
    """Rates and copies of every row of ``docs``.

    ``labelled``: text and domain; ``targets``: the share of tokens by domain.
    """
    domains = sorted(targets)
    whole = sum(targets.values())
    shares = [targets[d] / whole for d in domains]
    if min(shares) <= 0:
        raise ValueError("targets must be positive")
    members = materialise(posteriors(docs, train(labelled, domains)), "members")
    rate, found, met = fit_rates(members, shares, least, steps)
    if not met:
        said = ", ".join(f"{d} {x:.4f} of {s:.4f}" for d, x, s in zip(domains, found, shares, strict=True))
        warnings.warn(f"the rates miss the target shares: {said}", stacklevel=2)
    rated = members.withColumn("rate", rate)
    rows = rated.select("doc_id", "n_tokens", *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"), "text_low", "text_high")
    return Mixture(rows, dict(zip(domains, found, strict=True)), met)


def labelled_domains(docs: DataFrame, labels: DataFrame, domain: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """text and domain of at most ``sample`` texts that the labelled table names."""
    ids = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # at most ``sample`` rows of 8 bytes
    chosen = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(domain).cast("string").alias("domain"))
    return source.join(chosen, "doc_id").select("text", "domain")


def apply_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` with each row as often as its copies say; rows are told by id and text."""
    times = mixed.groupBy(*KEY).agg(F.max("copies").alias("_copies")).select("_copies", *(F.col(c).alias(f"_{c}") for c in KEY))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *row_key(docs))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    joined = rows.join(times, same[0] & same[1] & same[2], "left")
    times_ = F.coalesce("_copies", F.lit(1)).cast("int")
    return joined.where(times_ > 0).select("_row", F.explode(F.array_repeat(F.lit(1), times_)).alias("_time")).select("_row.*")
