"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Patterns give candidate spans; every candidate value is hashed, and for each hash the distinct repositories
and owners that hold it are counted over the whole corpus. A value held by WIDE or more owners is a widely
copied example; another one that is no placeholder is a live-looking credential of its owner. A private key is
its whole block, from the BEGIN line to the END line (without one, the lines of its body); a BEGIN line alone is weak.
Here a document stands for a repository and `source` for its owner; both are parameters.

Defined results: a null text counts as empty and has no span; repeated rows are returned each, and count
once as repository; rows with a null doc_id keep their spans but count in no frequency; values are masked in
the rows that hold them, whatever their doc_id; an empty table gives no rows; spans of different kinds may overlap and are all kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import listed, match_spans, merged, number_of, of_kind
from .tables import written

_LEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = _LEAD + r"[A-Za-z0-9+/_.=-]+"
ASSIGNED = "^" + _LEAD + r"([A-Za-z0-9+/_.=-]+)$"
#: A match is the longest run, so asking for the least length in the pattern drops the same matches.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
BASE = ["assign", "access", "hex"]
#: A line break of a key, also one that is written out in a quoted string.
_BREAK = r"(?:\s|\\[nr])"
PEM_LINE = r"-----(?:BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----"
#: Up to the END line; a block that is cut off ends with the lines of its body.
PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{_BREAK}*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:{_BREAK}*+[A-Za-z0-9+/=]{{40,}}+)++(?:{_BREAK}++[A-Za-z0-9+/]++={{1,2}})?)?+"
)
#: Kinds found beyond the base ones.
MORE = {
    "pem": PEM,
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "provider": r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35,}+)",
}
#: Owners from which a value is a widely copied example.
WIDE = 3


def secret_spans(text: Column) -> Column:
    """All spans of a text, by start and kind; value is the secret itself."""
    assign = match_spans(text, ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGNED, 1)) >= 12)
    kinds = [of_kind(assign, "assign", 0), of_kind(match_spans(text, ACCESS), "access", 1), of_kind(match_spans(text, HEX), "hex", 2)]
    kinds += [of_kind(match_spans(text, p), k, 3 + i) for i, (k, p) in enumerate(MORE.items())]
    return merged(kinds)


def secret_of(span: Column) -> Column:
    """The value without the words that assign it."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGNED, 1)).otherwise(span["value"])


def looks_live(value: Column, kind: Column) -> Column:
    """Long, made of many different characters, and no placeholder; of a private key the body counts."""
    body = F.when(kind == "pem", F.regexp_replace(value, PEM_LINE, "")).otherwise(value)
    kinds = F.size(F.array_distinct(F.split(F.lower(body), "")))
    # four equal letters are no sign of a placeholder in long random text
    filler = F.when(kind.isin("pem", "jwt"), body.rlike("(?i)x{8}")).otherwise(body.rlike("(?i)xxxx"))
    return (F.length(body) >= 12) & (kinds >= 6) & ~filler & ~body.rlike("(?i)example|placeholder|changeme|0123456789|abcdef0123|your_")


def owner_of(docs: DataFrame, owner: str) -> Column:
    return F.coalesce(F.col(owner).cast("string") if owner in docs.columns else F.lit(""), F.lit(""))


def scanned(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, owner, spans of each row, written: the texts are scanned once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner_of(docs, owner).alias("owner"), secret_spans(text).alias("spans")), "secrets")


def values(found: DataFrame, *keys: str) -> DataFrame:
    """keys, value, hash, live (under any of its kinds) for each distinct value."""
    each = found.select(*keys, F.explode("spans").alias("span"))
    each = each.select(*keys, secret_of(F.col("span")).alias("value"), F.col("span.kind").alias("kind"))
    each = each.select(*keys, "value", F.sha2("value", 256).alias("hash"), looks_live(F.col("value"), F.col("kind")).alias("live"))
    return each.groupBy(*keys, "value", "hash").agg(F.bool_or("live").alias("live"))


def spread(each: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners from distinct (doc_id, owner, hash)."""
    return each.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def ownership(found: DataFrame) -> DataFrame:
    """doc_id, value, hash, n_repositories, n_owners, verdict for each distinct value of a document."""
    each = values(found.where("doc_id is not null"), "doc_id", "owner")
    verdict = F.when(F.col("n_owners") >= WIDE, "copied").when(F.col("live"), "live").otherwise("weak")
    return each.join(spread(each), "hash").select("doc_id", "value", "hash", "n_repositories", "n_owners", verdict.alias("verdict"))


def secrets(docs: DataFrame, owner: str = "source") -> DataFrame:
    """One row per document: doc_id, spans, how many distinct values are live, copied or weak, and the widest spread."""
    found = scanned(docs, owner)
    count = {f"n_{v}": F.count_if(F.col("verdict") == v) for v in ("live", "copied", "weak")}
    by_doc = ownership(found).select("doc_id", "hash", "verdict", "n_owners").distinct().groupBy("doc_id")
    by_doc = by_doc.agg(*[c.alias(n) for n, c in count.items()], F.max("n_owners").alias("most_owners"))
    out = found.join(by_doc, "doc_id", "left")
    return out.select("doc_id", "spans", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in [*count, "most_owners"]])


def redacted(docs: DataFrame, owner: str = "source", mark: str = "<SECRET>") -> DataFrame:
    """The documents, all kept, with live-looking values replaced by `mark`; n_chars follows the text. Null texts stay null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number"), owner_of(docs, owner).alias("owner"), secret_spans(text).alias("spans"))
    rows = written(rows, "scanned")
    held = rows.where(F.size("spans") > 0)
    each = values(held.select("number", F.col("row.doc_id").cast("long").alias("doc_id"), "owner", "spans"), "number", "doc_id", "owner")
    wide = spread(each.where("doc_id is not null").select("doc_id", "owner", "hash").distinct()).where(F.col("n_owners") >= WIDE)
    live = each.where("live").join(wide, "hash", "left_anti").groupBy("number").agg(F.collect_set("value").alias("live"))
    live = live.withColumn("live", F.array_sort("live", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).otherwise(F.when(a > b, 1).otherwise(0))))
    masked = F.aggregate("live", F.col("row.text"), lambda t, v: F.replace(t, v, F.lit(mark)))
    row = F.col("row").withField("text", masked)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(masked).cast(docs.schema["n_chars"].dataType))
    out = held.join(live, "number", "left").select(F.when(F.col("live").isNull(), F.col("row")).otherwise(row).alias("row"))
    return out.unionByName(rows.where(F.size("spans") == 0).select("row")).select("row.*")
