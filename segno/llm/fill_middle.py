"""Fill-in-the-middle: documents cut at two places between units and put together with their middle last.

A unit is a word with the white space before it, or white space at the end. One fullmatch of (unit)* keeps every
repetition of its group, so its ends give the number of units and both cuts. Units never share characters and all
quantifiers are possessive, so that a match does not go back whatever the length of the text. The draws are the
first four 8-digit groups of a sha256 of seed and doc_id: the same on every machine and in every run.

Defined results: a null text counts as empty and an empty one stays plain; so does a text that holds one of the marks,
since it could not be taken apart again; a null doc_id draws as the empty word; rows that repeat a doc_id draw alike; an
empty table gives no rows; columns beside doc_id and text are kept as they are, and columns named like a new one give way to it.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: a unit, the marks of prefix, suffix and middle, the seed, and shares in per cent.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_SHARE = 42, 50, 80
FORMS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def cuts(texts: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    """n units of each text, and where the units before the smaller and the larger of one % (n + 1), other % (n + 1) end."""
    units = regex.compile(f"({UNIT})*+")

    def cut(text: str, a: int, b: int) -> dict:
        ends = units.fullmatch(text).ends(1)
        low, high = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
        return {"n": len(ends), "first": ends[low - 1] if low else 0, "second": ends[high - 1] if high else 0}

    rows = (cut(t.as_py() or "", a.as_py(), b.as_py()) for t, a, b in zip(texts, one, other))
    return pa.array(rows, pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())]))


def draws(seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """The documents with n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output.

    `rate` per cent of the documents are transformed, `spm_share` per cent of those with their suffix first.
    """
    where = F.arrow_udf(cuts, "struct<n:long,first:long,second:long>")
    text, (h1, h2, h3, h4) = F.coalesce(F.col("text"), F.lit("")), draws(seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")
    kept = [c for c in docs.columns if c not in FORMS]
    cut = docs.select(F.struct(*kept).alias("row"), text.alias("text"), where(text, h1, h2).alias("at"), form.alias("form"))
    first, second = F.col("at.first").cast("int"), F.col("at.second").cast("int")
    prefix, suffix = F.substr("text", F.lit(1), first), F.substr("text", second + 1)
    middle = F.substr("text", first + 1, second - first)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    moved = F.col("form") != "plain"
    prefix_chars, middle_chars = F.when(moved, F.col("at.first")), F.when(moved, F.col("at.second") - F.col("at.first"))
    return cut.select("row.*", "at.n", "form", prefix_chars.alias("prefix_chars"), middle_chars.alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No mark stands in the text and none overlaps itself, so each is where it was put."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
