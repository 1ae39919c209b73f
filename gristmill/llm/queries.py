"""The queries of the nine problems of training data; each reads its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import docpairs, leaks, licenses, mixing, origin, parsing, personal, secrets, splitting


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.function_pairs(_t(spark, d, "repo_files"), with_text=False).select("file_id", "func_name", "line_no").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.function_pairs(_t(spark, d, "repo_files"))


def p1_listed(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "repo_files")
    return docpairs.listed_share(docpairs.function_pairs(files, with_text=False), _t(spark, d, "ast_data"), files)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.syntax_verdicts(_t(spark, d, "repo_files")).filter(~F.col("parses")).select("file_id")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_rates(parsing.syntax_verdicts(_t(spark, d, "repo_files"), keep=("repo_id",)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.cut_kinds(splitting.split_items(_t(spark, d, "repo_files"), only_oversized=True))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.item_pieces(splitting.split_items(_t(spark, d, "repo_files"), only_oversized=True))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.origins(_t(spark, d, "repo_files"), _t(spark, d, "repositories")).filter("origin <> 'hand'").select("file_id")


def p4_origins(spark: SparkSession, d: str) -> DataFrame:
    return origin.origins(_t(spark, d, "repo_files"), _t(spark, d, "repositories"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.credential_spans(_t(spark, d, "repo_files")).select("file_id", "line_no").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redacted(_t(spark, d, "repo_files")).filter("credentials > 0")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return licenses.license_rows(_t(spark, d, "repo_files"), _t(spark, d, "repositories"), _t(spark, d, "license_catalog"))


def p6_effective(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "repo_files")
    return licenses.effective_licenses(files, licenses.license_rows(files, _t(spark, d, "repositories"), _t(spark, d, "license_catalog")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d, "eval_items")
    return leaks.leaked_items(leaks.leaks(_t(spark, d, "documents"), items), items)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_t(spark, d, "documents"), _t(spark, d, "source_targets")).drop("exponent")


def p8_tempered(spark: SparkSession, d: str) -> DataFrame:
    return mixing.tempered_shares(_t(spark, d, "documents"), _t(spark, d, "source_targets"), epochs=1.5)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = _t(spark, d, "source_targets")
    return mixing.mixture_shares(mixing.mixture(_t(spark, d, "documents"), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_entities(_t(spark, d, "documents")).select("doc_id", "start_pos", "pii_type")


def p9_placeholders(spark: SparkSession, d: str) -> DataFrame:
    return personal.pseudonymised(_t(spark, d, "documents"), secret="a key that a user sets").filter("entities > 0")


def p9_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return personal.surrogate_table(personal.personal_entities(_t(spark, d, "documents"), with_text=True), secret="a key that a user sets")


_ALL = [p1_found, p1_pairs, p1_listed, p2_found, p2_rates, p3_found, p3_pieces, p4_found, p4_origins, p5_found, p5_redacted, p6_found, p6_effective, p7_found, p7_items, p8_mix, p8_shares, p8_tempered, p9_found, p9_placeholders, p9_surrogates]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def _grams(table: str, key: str) -> str:
    """Runs of twelve words of a text, without markup, entities, invisible characters and case."""
    inline = r"</?(?:a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var)(?:\s[^<>]*)?/?>"
    plain = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{inline}', '', 'g'), '</?[A-Za-z][^<>]*>', ' ', 'g'), '&(?:nbsp|amp|lt|gt|quot|#160);', ' ', 'g'), '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}]', '', 'g')"
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM (SELECT {key}, regexp_extract_all(lower({plain}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12"


def oracle_sql() -> dict[str, str]:
    """What SQL can say of these operators over the whole tables."""
    leaked = f"SELECT DISTINCT doc_id, item_id FROM ({_grams('documents', 'doc_id')}) JOIN ({_grams('eval_items', 'item_id')}) USING (g)"
    return {
        "p7_found": leaked,
        "p7_items": f"SELECT item_id, suite, eval_split, CAST(coalesce(n, 0) AS BIGINT) AS documents FROM eval_items LEFT JOIN (SELECT item_id, count(*) AS n FROM ({leaked}) GROUP BY item_id) USING (item_id)",
        "p3_found": r"""
            SELECT file_id, CASE WHEN regexp_matches(content, '[^\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{1000}[^\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{1000}[^\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')
                THEN 'forced' ELSE 'natural' END AS cut_kind
            FROM repo_files WHERE length(content) > 2000""",
    }
