"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import hashlib
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import (
    bpe,
    exact_dedup,
    html_text,
    language,
    line_dedup,
    lm,
    mixing,
    nearest,
    periodic_runs,
    quality,
    simhash,
    url_filter,
    vector_codes,
)
from twinloom.llm.common import id_remainder, table, words_of

# The file that the contract names, in the package of public vocabularies.
TOKENIZER = "word_bpe_49k.json"
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def tokenizer_path() -> str:
    return importlib.import_module("public_tokenizers").path(TOKENIZER)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    learned = language.learn_profiles(docs.where(~held_out))
    found = language.identify(docs, learned)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dropped_lines(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 7) == 2
    return lm.score_texts(table(spark, sf_dir, "documents").withColumn("held_out", held_out))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def _made_periodic(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` as the contract wants them: a tenth of the texts ends in a repeated part.

    Where crc32 of the id is ``h = 10 * g``, words from the ``g % n``-th on repeat with a period. Texts
    of missing ids stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words_of(F.col("text"))).alias("w"))
    size = chosen.withColumn("n", F.size("w"))
    start = F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int"))
    placed = size.withColumn("a", start)
    left = F.col("n") - F.col("a")
    placed = placed.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    part = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(part, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    periodic = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs.periodic_runs(_made_periodic(docs))
    # Runs come by start and period, so the first of equally strong ones is the one to keep.
    none = F.lit(None).cast(periodic_runs.RUN)
    best = F.reduce(
        "runs",
        none,
        lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return vector_codes.total_errors(coded).select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_bpe,
        op3_line_dedup,
        op4_quality_rules,
        op5_exact_dedup,
        op6_lm_scoring,
        op7_html_extraction,
        op8_mixing,
        op9_simhash,
        op10_url_filters,
        op11_periodic_runs,
        op12_nearest_neighbours,
        op13_vector_codes,
    )
}


def _listed(texts: tuple[str, ...]) -> str:
    return ", ".join(f"'{t}'" for t in texts)


def _prior_weight_sql(groups: str) -> str:
    """The method of moments over ``(bad, n, m)``, m being the prior mean."""
    return f"""(SELECT CASE WHEN spread > 0 AND most > 0 THEN least(greatest(most / spread - 1, 1.0), 1000.0)
                      ELSE 1000.0 END AS w
               FROM (SELECT sum((bad - n * m) ** 2 - n * m * (1 - m)) AS spread,
                            sum(n * (n - 1) * m * (1 - m)) AS most FROM {groups} WHERE n > 1))"""


def _nearest_sql(book: str) -> str:
    """Nearest entry ``e`` and squared distance ``d`` of each part; the distance leads in one number."""
    far = " + ".join(f"(p.x{k} - b.x{k}) ** 2" for k in range(4))
    return f"""(SELECT r, part, m % 64 AS e, m // 64 AS d FROM (SELECT r, part, min(({far})::BIGINT * 64 + e) AS m
               FROM p JOIN {book} b USING (part) GROUP BY r, part))"""


def _moved_sql(book: str) -> str:
    """Entries moved to the floor of their parts' mean; unused ones stay."""
    means = ", ".join(f"floor(sum(x{k}) / count(*))::BIGINT AS x{k}" for k in range(4))
    now = ", ".join(f"coalesce(m.x{k}, b.x{k}) AS x{k}" for k in range(4))
    return f"""(SELECT b.part, b.e, {now} FROM {book} b LEFT JOIN (SELECT part, e, {means}
               FROM p JOIN {_nearest_sql(book)} USING (r, part) GROUP BY part, e) m USING (part, e))"""


ORACLES = {
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
                   FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)
    """,
    "op10_url_filters": rf"""
        WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3)
                                        ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                     translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz') AS host FROM a),
        l AS (SELECT doc_id AS page_id, CASE WHEN quality <= 0 OR toxic > 0 THEN 1
                     WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS bad FROM labels),
        c AS (SELECT host, coalesce(sum(bad), 0)::DOUBLE AS bad, count(bad)::DOUBLE AS n
              FROM s LEFT JOIN l USING (page_id) GROUP BY host),
        b AS (SELECT host, bad, n, regexp_replace(host, ':[0-9]*$', '') AS bare FROM c),
        k AS (SELECT *, CASE WHEN regexp_extract(bare, '[^.]*\.[^.]*$') IN ({_listed(url_filter.SUFFIXES)}) THEN 1 ELSE 0 END AS more,
                     regexp_matches(bare, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$|^\[') AS address FROM b),
        h AS (SELECT host, bad, n,
                     CASE WHEN address THEN bare WHEN more = 1 THEN regexp_extract(bare, '([^.]*\.)?[^.]*$')
                          ELSE regexp_extract(bare, '[^.]*$') END AS suffix,
                     CASE WHEN address THEN bare WHEN more = 1 THEN regexp_extract(bare, '([^.]*\.)?([^.]*\.)?[^.]*$')
                          ELSE regexp_extract(bare, '([^.]*\.)?[^.]*$') END AS domain FROM k),
        d AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM h GROUP BY domain, suffix),
        x AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM d GROUP BY suffix),
        o AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) ELSE 0.5::DOUBLE END AS m FROM h),
        x1 AS (SELECT suffix, bad, n, m FROM x, o),
        x2 AS (SELECT suffix, (m * w + bad) / (w + n) AS m FROM x1, {_prior_weight_sql("x1")}),
        d1 AS (SELECT domain, bad, n, m FROM d JOIN x2 USING (suffix)),
        d2 AS (SELECT domain, (m * w + bad) / (w + n) AS m FROM d1, {_prior_weight_sql("d1")}),
        h1 AS (SELECT host, bad, n, m FROM h JOIN d2 USING (domain)),
        h2 AS (SELECT host, m * w + bad AS a, (1 - m) * w + n - bad AS b FROM h1, {_prior_weight_sql("h1")}),
        r AS (SELECT host, a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS bound FROM h2),
        f AS (SELECT page_id, host, path, bound,
                     CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                          WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                          WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                          WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
              FROM s JOIN r USING (host))
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                    WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
               round(bound, 6) AS bad_rate_bound
        FROM f
    """,
    "op13_vector_codes": f"""
        WITH k AS MATERIALIZED (
            SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
            FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        p AS MATERIALIZED (
            SELECT r, part, {", ".join(f"floor(256 * v[4 * part + {k + 1}]::DOUBLE)::BIGINT AS x{k}" for k in range(4))}
            FROM k, range(16) AS t(part)),
        b0 AS MATERIALIZED (SELECT part, r - 1 AS e, x0, x1, x2, x3 FROM p WHERE r <= 64),
        b1 AS MATERIALIZED {_moved_sql("b0")},
        b2 AS MATERIALIZED {_moved_sql("b1")},
        f AS MATERIALIZED (
            SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
            FROM {_nearest_sql("b2")} GROUP BY r),
        h AS (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM k JOIN f USING (r), h
    """,
}
