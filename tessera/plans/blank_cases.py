"""Queries over texts with all kinds of white space: no-break and ideographic spaces, tabs, line ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.purl import purl_rest
from ..operators import recognize
from ..sources import readers

#: A key stands for one of these and for none twice in a row.
BLANKS = ["\t", "\xa0", "　", " ", "\x85", "\x0b", " ", " \xa0 "]


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = readers.spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k")))
    return table.withColumn("b", F.element_at(F.array(*[F.lit(b) for b in BLANKS]), (F.col("k") % len(BLANKS) + 1).cast("int")))


def _filled(text: str):
    """``text`` with the key for ``@k`` and its white space for ``_``."""
    return F.replace(F.replace(F.lit(text), F.lit("@k"), F.col("k").cast("string")), F.lit("_"), F.col("b"))


_SCRIPT = "_npm_install_a@k_b@k@1_\n\tcurl_https://x.y/p@k_tail_\r\nsudo git_clone_-q_https://g.h/r@k.git_dir\nx git+https://g.h/s@k.git_y\n"


def blank_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands, URLs and repositories of scripts whose words are parted by any white space."""
    files = _keys(spark, sf_dir).select(F.col("k").alias("file_id"), F.lit("shell").alias("file_type"), _filled(_SCRIPT).alias("text"))
    found = recognize.commands(files).unionByName(recognize.urls(files)).unionByName(recognize.git_refs(files))
    return found.select("file_id", "kind", "locator", F.translate("evidence", "".join(BLANKS), "_" * len("".join(BLANKS))).alias("evidence"))


def blank_docker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base distributions of Dockerfiles whose words are parted by any white space."""
    files = _keys(spark, sf_dir).select(F.col("k").alias("file_id"), F.lit("dockerfile").alias("file_type"), _filled("FROM_--platform=x_ubuntu:22_AS_b\nRUN_apt-get_install_-y_u@k\nfrom_alpine\nRUN apk_add_l@k_&&_echo\n").alias("text"))
    return recognize.commands(files).select("file_id", "locator")


def blank_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of stanzas, elements and texts with white space around them."""
    rows = _keys(spark, sf_dir).select(
        "k", _filled("X:1\nP:_n@k_\r\nV:__\r\n").alias("stanza"), _filled("<name>_a &lt;@k&gt;\n_</name>").alias("xml"), _filled("_M @k_<m@x>_").alias("person"), _filled("_\r\n__\n_l@k_\r\nz").alias("lines"), _filled("<b>_h@k</b>_\n").alias("html"), _filled("_pkg:NPM/p@k_").alias("purl")
    )
    return rows.select(
        "k", S.stanza_field("stanza", "P:").alias("name"), S.stanza_field("stanza", "V:").alias("version"), S.tag_text("xml", "name").alias("tag"), S.strip_email("person").alias("person"), S.first_line("lines").alias("line"), S.strip_html("html").alias("html"), purl_rest("purl").alias("rest")
    )


QUERIES = {"blank_references": blank_references, "blank_docker": blank_docker, "blank_fields": blank_fields}


def _b(text: str) -> str:
    """Oracle text of a template: ``_`` for each character of white space (one of the kinds is three long)."""
    return "replace(replace(replace('" + text + "', '@k', '' || c_custkey), '_', CASE WHEN c_custkey % 8 = 7 THEN '___' ELSE '_' END), ' ', '_')"


ORACLES = {
    "blank_references": " UNION ALL ".join(
        f"SELECT c_custkey AS file_id, '{kind}' AS kind, replace('{locator}', '@k', '' || c_custkey) AS locator, {_b(evidence)} AS evidence FROM customer"
        for kind, locator, evidence in (
            ("command", "pkg:npm/a@k", "npm_install_a@k_b@k@1"), ("command", "pkg:npm/b@k@1", "npm_install_a@k_b@k@1"), ("url_fetch", "https://x.y/p@k", "curl_https://x.y/p@k_tail"), ("url_fetch", "https://g.h/r@k.git", "sudo git_clone_-q_https://g.h/r@k.git_dir"),
            ("url_fetch", "https://g.h/s@k.git", "x git+https://g.h/s@k.git_y"), ("repository", "https://g.h/r@k", "sudo git_clone_-q_https://g.h/r@k.git_dir"), ("repository", "https://g.h/s@k", "x git+https://g.h/s@k.git_y"),
        )
    ),
    "blank_docker": "SELECT c_custkey AS file_id, 'pkg:ubuntu/u' || c_custkey AS locator FROM customer UNION ALL SELECT c_custkey, 'pkg:alpine/l' || c_custkey FROM customer",
    "blank_fields": "SELECT c_custkey AS k, 'n' || c_custkey AS name, CAST(NULL AS VARCHAR) AS version, 'a <' || c_custkey || '>' AS tag, 'M ' || c_custkey AS person, 'l' || c_custkey AS line, 'h' || c_custkey AS html, 'p' || c_custkey AS rest FROM customer",
}
