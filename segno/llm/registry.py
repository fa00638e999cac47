"""One query for each operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, pii, secret_scan
from .decontam import contaminated
from .fill_middle import fill_in_middle, restored
from .licenses import license_scan
from .lm_score import cross_entropy_difference
from .neardup import near_duplicates
from .passages import repeated_passages
from .pieces import encode
from .quality import quality_scores
from .spans import listed, number_of
from .tables import table
from .topk import top_k
from .toxicity import toxicity_scores
from .whitening import whitened_components

Query = Callable[[SparkSession, str], DataFrame]


def op6_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op7_pii_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(pii.personal_data(table(spark, sf_dir, "documents")), pii.BASE)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where("vec_id % 20 = 0"), vectors)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def span_digest(found: DataFrame, base: list[str], *more: str) -> DataFrame:
    """doc_id, n_<kind> and the digest of the base spans, and all spans as text."""
    own = F.filter("spans", lambda x: x["kind"].isin(base))
    counts = [number_of(F.col("spans"), k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *more)


def op1_passage_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    return span_digest(found, secret_scan.BASE, "n_live", "n_copied", "n_weak", "most_owners")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rebuilt = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


def op12_license_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op13_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


QUERIES: list[Query] = [
    op1_passage_chaining,
    op2_benchmark_decontamination,
    op3_toxicity_factorization,
    op4_cross_entropy_difference,
    op5_secret_ownership,
    op6_sentencepiece_lattice,
    op7_pii_boosted_candidates,
    op8_quality_rules,
    op9_histogram_top_k,
    op10_minhash_near_dedup,
    op11_fill_in_middle,
    op12_license_positions,
    op13_spectrum_whitening,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def _values(rows: list[tuple]) -> str:
    """Rows of words, numbers and lists of words as a VALUES list."""
    one = lambda v: "[" + ", ".join(map(one, v)) + "]" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def license_sql() -> str:
    """The licence scan as joins of exploded words; only the fixed tables of templates are shared with the operator."""
    whole = [(label, "true", p.split(), [p]) for p, label in licenses.PHRASES.items()] + [(label, "false", text.split(), keys) for label, text, keys in licenses.TEMPLATES]
    return rf"""
        WITH t AS (SELECT row_number() OVER () AS r, * FROM (VALUES {_values(whole)}) v(label, base, words, keys)),
             d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
             tw AS (SELECT r, base, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS o FROM t),
             dw AS (SELECT n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
             df AS (SELECT v.word, count(DISTINCT n) AS c FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN dw USING (word) GROUP BY v.word),
             ranked AS (SELECT r, base, word, round(ln(((SELECT count(*) FROM d) + 1) / (c + 1)) + 0.001, 6) AS weight, row_number() OVER (PARTITION BY r ORDER BY c, word) AS place
                        FROM (SELECT DISTINCT r, base, word FROM tw) JOIN df USING (word)),
             rare AS (SELECT r, word, weight, CASE WHEN base THEN 0 ELSE 3 END AS drift FROM ranked WHERE place <= CASE WHEN base THEN 1 ELSE 6 END),
             votes AS (SELECT DISTINCT dw.n, tw.r, dw.i - tw.o AS start FROM rare JOIN tw USING (r, word) JOIN dw ON dw.word = rare.word),
             near AS (SELECT v.n, v.r, v.start, rare.word, max(rare.weight) AS weight, max(CASE WHEN dw.n IS NULL THEN 0 ELSE 1 END) AS has
                      FROM votes v JOIN rare ON rare.r = v.r JOIN tw ON tw.r = rare.r AND tw.word = rare.word
                      LEFT JOIN dw ON dw.n = v.n AND dw.word = rare.word AND dw.i BETWEEN v.start + tw.o - rare.drift AND v.start + tw.o + rare.drift
                      GROUP BY v.n, v.r, v.start, rare.word),
             shares AS (SELECT n, r, start, least(sum(weight * has) / sum(weight), 1.0) AS share FROM near GROUP BY n, r, start),
             keyed AS (SELECT s.n, s.r, s.start, s.share, t.label, t.base, d.ws, t.words, string_split(k.key, ' ') AS part, CASE WHEN t.base THEN 0 ELSE 3 END AS drift
                       FROM shares s JOIN t USING (r) JOIN d USING (n), unnest(t.keys) k(key)),
             placed AS (SELECT *, list_filter(range(len(words)), lambda j: words[j + 1 : j + len(part)] = part)[1] AS key_at FROM keyed),
             held AS (SELECT n, r, start, max(share) AS share, any_value(label) AS label, any_value(base) AS base,
                             bool_and(len(list_filter(range(-drift, drift + 1), lambda j: start + key_at + j >= 0 AND ws[start + key_at + j + 1 : start + key_at + j + len(part)] = part)) > 0) AS verified
                      FROM placed GROUP BY n, r, start),
             counted AS (SELECT n, max(share) AS any_share, max(share) FILTER (verified AND (base OR share >= 0.7)) AS match_share, count(*) FILTER (verified AND base) AS n_base,
                                min(start) FILTER (verified AND base) AS first_word, max(start) FILTER (verified AND base) AS last_word,
                                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified AND base) AS base_labels,
                                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified AND (base OR share >= 0.7)) AS labels FROM held GROUP BY n)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(greatest(coalesce(match_share, 0), coalesce(any_share, 0) / 2), 6) AS score
        FROM d LEFT JOIN counted USING (n)"""


ORACLES = {
    "op9_histogram_top_k": """
        WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
             s AS (SELECT q.vec_id AS query_id, c.vec_id,
                          CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM c q JOIN c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
             r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
             u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM d),
             c AS (SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
                               WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
             p AS (SELECT *, array_to_string(units[1 : least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1 : greatest(a, b)], '') AS middle,
                          array_to_string(units[greatest(a, b) + 1 :], '') AS suffix FROM c),
             o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END AS output FROM p),
             s AS (SELECT *, string_split_regex(output, '<P>|<S>|<M>') AS parts FROM o)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256,
               sha256(CASE form WHEN 'psm' THEN parts[2] || parts[4] || parts[3] WHEN 'spm' THEN parts[3] || parts[4] || parts[2] ELSE output END) AS restored_sha256
        FROM s""",
    "op12_license_positions": license_sql(),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
