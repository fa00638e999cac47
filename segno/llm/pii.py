"""Personal data: candidates by patterns, boosted trees over format and context, calibrated thresholds.

DataFrame operations only. High-recall patterns propose overlapping spans; base spans that pass the exact check of
their kind are kept. There are no labels of personal data, so evidence from outside a candidate's format labels it:
a word before it that names its kind, another generator that takes it in (a local number behind the beginning of an
international one), or check digits (Luhn sums, IBAN) and ranges. The features hold none of this: they are binned
format and the sign before. Trees are boosted on the counts of candidates by feature values (a table whose size the
bins bound, whatever the input) of four fifths of the documents, and compiled into column expressions.

What may be added (open) is no base span, does not fail a check that settles its kind (a card, an address, an IBAN)
and does not stand within a base span's number. On the other fifth of the documents, those whose crc32(doc_id) mod 5
is 0, the lowest threshold of each kind is taken down to which open candidates are right in PRECISION of the cases,
with one right and one wrong case added to what was counted; `report` gives precision and recall of open candidates
there. Where open candidates have no evidence, as in a corpus that never names what follows, nothing is added. Those
at or above the threshold are added under kinds of their own; `redacted` masks all spans.

Defined results: a null text counts as empty and has no span; repeated rows are returned each; a null doc_id
is kept; an empty table gives no rows; spans of different kinds may overlap and are all kept; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import match_spans
from .tables import held_out, written

#: Base patterns. Possessive loops and \\G only keep Java's matcher linear; they find the same matches.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
BASE = ["email", "ip", "card", "phone"]
KINDS = list(PATTERNS)
#: Words that name a kind before its value.
CUES = {
    "email": "mail|contact", "ip": "ip|host|server", "card": "card|visa|credit|pay", "phone": "phone|tel|call|fax|mobile", "ssn": "ssn|social", "iban": "iban|account",
    "local_phone": "phone|tel|call|fax|mobile",
}
#: Share of right candidates above a threshold.
PRECISION = 0.9
TREES, RATE = 30, 0.3


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(value: Column) -> Column:
    figures = F.split(F.reverse(digits(value)), "")
    doubled = F.transform(
        figures, lambda x, i: F.when(i % 2 == 0, F.coalesce(x.try_cast("int"), F.lit(0))).otherwise(F.coalesce(x.try_cast("int"), F.lit(0)) * 2 - F.when(x > "4", 9).otherwise(0))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes_mod_97(value: Column) -> Column:
    """The check digits of an IBAN."""
    plain = F.regexp_replace(value, "[^A-Z0-9]", "")
    signs = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")
    code = F.transform(F.filter(signs, lambda x: x != ""), lambda x: F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55))
    return F.aggregate(code, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def passes(kind: str, value: Column) -> Column:
    """The exact check of a kind."""
    n = F.length(digits(value))
    if kind == "ip":
        small = lambda p: (F.length(p) == 0) | ((F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0"))), small)
    if kind == "card":
        return F.when(n.between(14, 19), passes_luhn(value)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "ssn":
        return ~value.rlike("^(000|666|9)") & ~value.rlike("-00-") & ~value.rlike("0000$")
    if kind == "local_phone":
        return F.lit(True)
    if kind == "email":
        return value.rlike(r"^[A-Za-z0-9_+].*@[A-Za-z0-9].*\.[A-Za-z]{2,24}$") & ~value.contains("..")
    return passes_mod_97(value)


def binned(x: Column, *edges: int) -> Column:
    """How many of the edges x reaches."""
    out = F.lit(0)
    for i, e in enumerate(edges):
        out = F.when(x >= e, i + 1).otherwise(out)
    return out


FEATURES = ["kind_no", "digits", "signs", "variety", "size", "left", "lead"]


def evidence(kind: str, span: Column) -> tuple[Column, Column]:
    """(the candidate is right, it may be added), from what the features do not hold."""
    good = passes(kind, span["value"])
    named = F.lower(span["before"]).rlike(rf"(?<![a-z])(?:{CUES[kind]})")
    within = span["before"].rlike(r"\+[0-9][\x20().0-9-]*$")  # behind the beginning of an international number
    return {
        "phone": (good | named, ~good), "ssn": (good & named, good), "local_phone": (named | within, ~within), "iban": (good, good)
    }.get(kind, (good, F.lit(False)))


def features(kind: str, span: Column) -> list[Column]:
    v, before = span["value"], F.lower(span["before"])
    left = F.when(before == "", 0).when(before.rlike(r"\s$"), 1).when(before.rlike("[a-z]$"), 2).when(before.rlike("[0-9]$"), 3).otherwise(4)
    lead = F.when(v.startswith("+"), 0).when(v.startswith("0"), 1).when(v.rlike("^[0-9]"), 2).otherwise(3)
    each = [
        F.lit(KINDS.index(kind)), binned(F.length(digits(v)), 1, 7, 10, 13, 14, 16, 17, 20), binned(F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")), 1, 2, 3, 4),
        binned(F.size(F.array_distinct(F.split(digits(v), ""))), 3, 6), binned(F.length(v), 8, 12, 16, 20, 32), left, lead,
    ]
    return [c.alias(n) for c, n in zip(each, FEATURES)]


def described(order: int, kind: str):
    """What a span becomes as a candidate of its kind."""
    def candidate(x: Column) -> Column:
        # every match of the email pattern is a base span
        base = F.lit(kind == "email") if kind in ("email", *KINDS[len(BASE) :]) else passes(kind, x["value"])
        right, open_ = evidence(kind, x)
        return F.struct(
            x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"), base.alias("base"), right.alias("right"), open_.alias("open"), *features(kind, x)
        )

    return candidate


def candidates(text: Column) -> Column:
    """start, order, end, kind, base (a base span), right and open (see evidence) and FEATURES of all proposals."""
    out = []
    for i, kind in enumerate(KINDS):
        found = match_spans(text, PATTERNS[kind])
        if kind == "card":  # short runs of figures are no proposals
            found = F.filter(found, lambda x: F.length(digits(x["value"])) >= 13)
        if kind == "ip":
            found = F.filter(found, lambda x: F.length(x["value"]) >= 7)

        out.append(F.transform(found, described(i, kind)))
    return F.array_sort(F.concat(*out))


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, threshold) of the best split of weighted rows; gain 0 if none helps."""
    best = (1e-6, -1, 0)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            at = x[:, f] <= t
            gain = g[at].sum() ** 2 / (h[at].sum() + 1) + g[~at].sum() ** 2 / (h[~at].sum() + 1) - whole
            if gain > best[0]:
                best = (gain, f, int(t))
    return best if best[1] >= 0 else (0.0, -1, 0)


def boost(x: np.ndarray, n: np.ndarray, right: np.ndarray) -> tuple[float, list]:
    """Trees of two levels fitted to counts (n rows with these features, `right` of them right)."""
    start = float(np.log((right.sum() + 1) / (n.sum() - right.sum() + 1)))
    z, trees = np.full(len(n), start), []

    def grow(at: np.ndarray, depth: int):
        gain, f, t = best_split(x[at], g[at], h[at]) if depth else (0.0, -1, 0)
        if not gain:
            value = float(RATE * g[at].sum() / (h[at].sum() + 1))
            z[at] += value
            return value
        low = at & (x[:, f] <= t)
        return (f, t, grow(low, depth - 1), grow(at & ~low, depth - 1))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = right - n * p, n * p * (1 - p)
        trees.append(grow(np.ones(len(n), bool), 2))
    return start, trees


def thresholds(x: np.ndarray, n: np.ndarray, right: np.ndarray, z: np.ndarray) -> list[float]:
    """For each kind the lowest score down to which PRECISION of the candidates are right, one right and one wrong added; infinite if none."""
    out = []
    for k in range(len(KINDS)):
        at = np.flatnonzero(x[:, 0] == k)
        at = at[np.argsort(-z[at], kind="stable")]
        share = (np.cumsum(right[at]) + 1) / (np.cumsum(n[at]) + 2)
        whole = np.append(np.diff(z[at]) < -1e-9, True)[: len(at)]  # equal scores stand or fall together
        last = np.flatnonzero((share >= PRECISION) & whole)
        out.append(float(z[at[last[-1]]]) - 1e-9 if len(last) else float("inf"))
    return out


def tree_value(tree, c: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, t, low, high = tree
    return F.when(c[FEATURES[f]] <= t, tree_value(low, c)).otherwise(tree_value(high, c))


def margin(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, margin(low, x), margin(high, x))


class Model:
    """Boosted trees and the threshold of each kind, from counts of candidates by features."""

    def __init__(self, table: list):
        """table: rows of FEATURES, held (out), open, n, right."""
        self.x = np.array([[r[f] for f in FEATURES] for r in table]).reshape(-1, len(FEATURES))
        self.n, self.right = (np.array([r[c] for r in table], float) for c in ("n", "right"))
        held, open_ = (np.array([r[c] for r in table], bool) for c in ("held", "open"))
        own, self.proof = ~held, held & open_
        self.start, self.trees = boost(self.x[own], self.n[own], self.right[own]) if own.any() else (0.0, [])
        self.z = self.start + sum((margin(t, self.x) for t in self.trees), np.zeros(len(self.x)))
        self.least = thresholds(self.x[self.proof], self.n[self.proof], self.right[self.proof], self.z[self.proof])

    def report(self) -> list[tuple[str, int, int, int, float | None, float | None]]:
        """kind, open candidates, right ones, those at or above the threshold, their precision and recall, on what was held out."""
        out = []
        for k, kind in enumerate(KINDS):
            at = self.proof & (self.x[:, 0] == k)
            up = at & (self.z >= self.least[k])
            n, right, kept, hit = (float(v) for v in (self.n[at].sum(), self.right[at].sum(), self.n[up].sum(), self.right[up].sum()))
            out.append((kind, int(n), int(right), int(kept), hit / kept if kept else None, hit / right if right else None))
        return out


def learnt(docs: DataFrame, *keep: str) -> tuple[DataFrame, Model]:
    """doc_id, found of every row (and columns to keep), and the model learnt from them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(text).alias("found"), *keep), "candidates")
    table = found.select(held_out().alias("held"), F.explode("found").alias("c")).groupBy("held", *[F.col(f"c.{f}").alias(f) for f in ("open", *FEATURES)])
    return found, Model(table.agg(F.count("*").alias("n"), F.count_if("c.right").alias("right")).orderBy("held", "open", *FEATURES).collect())


def report(docs: DataFrame) -> DataFrame:
    """kind, candidates, right, kept, precision, recall of what may be added, on the documents the model was not fitted to."""
    rows = learnt(docs)[1].report()
    return docs.sparkSession.createDataFrame(rows, "kind string, candidates long, right long, kept long, precision double, recall double")


def personal_data(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and its spans (start, order, end, kind): base spans, and added ones (a phone that fails its check is a likely_phone)."""
    found, model = learnt(docs, *keep)
    start, trees, least = model.start, model.trees, model.least

    def likely(c: Column) -> Column:
        score = F.lit(start)
        for t in trees:
            score = score + tree_value(t, c)
        bound = F.lit(float("inf"))
        for k, b in enumerate(least):
            bound = F.when(c["kind_no"] == k, F.lit(b)).otherwise(bound)
        return score >= bound

    kept = F.filter("found", lambda c: c["base"] | (c["open"] & likely(c)))
    name = lambda c: F.when(c["base"], c["kind"]).when(c["kind"].isin(BASE), F.concat(F.lit("likely_"), c["kind"])).otherwise(c["kind"])
    return found.select("doc_id", *keep, F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["order"].alias("order"), c["end"].alias("end"), name(c).alias("kind"))).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id, text of every row with each span of personal data replaced by its kind in angle brackets."""
    found = personal_data(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")

    def step(acc, x):
        gap = F.when(x["start"] > acc["at"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])).otherwise(F.lit(""))
        mark = F.when(x["start"] >= acc["at"], F.concat(F.lit("<"), x["kind"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    cut = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return found.select("doc_id", F.concat(cut["out"], F.substring(F.col("text"), cut["at"] + 1, F.length("text"))).alias("text"))
