"""Named queries over the test tables, each with the SQL that states the same result.

Inputs are built by SQL that both engines run as it stands (``{table}`` is filled in for each), so an
oracle tests the operator and not the input. One query, ``html_meta``, builds its own input from whole pages.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import purl as P
from ..functions import scalars as S
from ..functions.json import jstr, ju64
from ..operators import fetching, layers, ranking, recognize, registry, resolve, sweep
from ..sources import readers
from . import blank_cases, lookup_cases, registry_cases, token_cases

QUERIES: dict = {}
ORACLES: dict = {}


def rows(spark: SparkSession, sf_dir: str, sql: str, spread: str | None = None) -> DataFrame:
    """Run input SQL over the Parquet tables of ``sf_dir``; rows of the table ``spread`` are dealt over all cores first."""
    if spread:
        view = f"spread_{uuid.uuid4().hex}"
        readers.spread(spark.read.parquet(f"{sf_dir}/{spread}.parquet")).createOrReplaceTempView(view)
        sql = sql.replace(f"{{{spread}}}", view)
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def query(name: str, inp: str, oracle: str | None = None, spread: str | None = None):
    """Register ``f(df)`` over ``inp``; the oracle reads the same rows as ``inp``. ``spread`` names a table to deal over all cores."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(rows(spark, sf_dir, inp, spread))
        if oracle is not None:
            ORACLES[name] = f"WITH inp AS ({re.sub(r'[{](.*?)[}]', lambda m: m[1] if m[1].isidentifier() else m[0], inp)}) {oracle}"
        return f

    return add


_SLUG = "replace(p_name, ' ', '_')"
PURLS = f"""SELECT p_partkey AS k, CASE p_partkey % 12
  WHEN 0 THEN 'pkg:npm/' || {_SLUG} || '@1.' || p_size
  WHEN 1 THEN 'PKG:NPM/@Scope/' || {_SLUG} || '@' || p_size
  WHEN 2 THEN ' pkg:pypi/My__' || {_SLUG} || '.X@1.' || p_size || ' '
  WHEN 3 THEN 'pkg:composer/Vendor/' || {_SLUG}
  WHEN 4 THEN 'pkg:debian/' || upper({_SLUG}) || '@' || p_size || '?arch=amd64'
  WHEN 5 THEN 'pkg:fedora/' || upper({_SLUG})
  WHEN 6 THEN 'pkg:deb/' || {_SLUG} || '?distro=Debian-12&x=1'
  WHEN 7 THEN 'pkg:cargo/' || {_SLUG} || '?a=1@2.' || p_size
  WHEN 8 THEN 'pkg:chrome/x/' || upper({_SLUG}) || '@1'
  WHEN 9 THEN 'pkg:openvsx/Ns/' || {_SLUG} || '@1?x=2'
  WHEN 10 THEN 'pkg:alpm/x/' || {_SLUG} || '?repository_url=https://aur.archlinux.org&k=v'
  ELSE 'npm/' || {_SLUG} END AS raw FROM {{part}}"""
_NORMAL = r"""
, t AS (SELECT k, raw, lower(regexp_extract(trim(raw), '^(?i:pkg):([^/]*)/', 1)) AS ty, regexp_extract(trim(raw), '^(?i:pkg):[^/]*/(.*)$', 1) AS rest FROM inp),
b AS (SELECT *, regexp_extract(rest, '^(@[^/@?]*/[^@?]*|[^@?]*)', 1) AS path0 FROM t),
c AS (SELECT *, regexp_replace(substr(rest, length(path0) + 1), '^\?(.*)@([^@=&/]+)$', '@\2?\1') AS tail, regexp_replace(path0, '^@', '%40') AS path FROM b),
d AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS last, regexp_replace(regexp_replace(tail, 'repository_url=https://aur.archlinux.org&?', ''), '[?&]$', '') AS cut, contains(tail, 'repository_url=https://aur.archlinux.org') AS aur FROM c),
n AS (SELECT k, raw, ty, path, tail, CASE WHEN ty = '' OR last = '' THEN NULL
  WHEN ty = 'chrome' THEN 'pkg:chrome-extension/' || lower(last) || tail
  WHEN ty = 'openvsx' THEN 'pkg:vscode-extension/' || lower(path) || tail || '&repository_url=https://open-vsx.org'
  WHEN ty = 'pypi' THEN 'pkg:pypi/' || lower(regexp_replace(path, '[-_.]+', '-', 'g')) || tail
  WHEN ty = 'composer' THEN 'pkg:composer/' || lower(path) || tail
  WHEN ty = 'alpm' AND aur THEN 'pkg:alpm/aur/' || lower(last) || cut
  WHEN ty = 'debian' THEN 'pkg:deb/debian/' || lower(last) || tail
  WHEN ty = 'fedora' THEN 'pkg:rpm/fedora/' || last || tail
  WHEN ty = 'deb' AND NOT contains(path, '/') AND regexp_matches(tail, '[?&]distro=(?i:debian)-') THEN 'pkg:deb/debian/' || path || tail
  ELSE 'pkg:' || ty || '/' || path || tail END AS normalized FROM d)
"""


@query("purl_normalize", PURLS, _NORMAL + "SELECT k, raw, normalized FROM n")
def _(df):
    return P.normalize(df, "raw")


@query("purl_identity", PURLS, _NORMAL + "SELECT k, regexp_extract(normalized, '^([^?]*)', 1) || CASE WHEN contains(normalized, 'repository_url=') THEN '?' || regexp_extract(normalized, '(repository_url=[^&]*)', 1) ELSE '' END AS identity FROM n")
def _(df):
    return P.identity(df, "raw").select("k", "identity")


@query("purl_parse", PURLS, r"""
, t AS (SELECT k, CASE WHEN regexp_matches(trim(raw), '^(?i:pkg):[^/]*/') THEN lower(regexp_extract(trim(raw), '^(?i:pkg):([^/]*)/', 1)) END AS type, regexp_extract(trim(raw), '^(?i:pkg):[^/]*/(.*)$', 1) AS rest FROM inp),
u AS (SELECT *, regexp_extract(rest, '^([^?]*)', 1) AS body FROM t)
SELECT k, type, CASE WHEN type IS NULL THEN NULL WHEN contains(body, '@') THEN regexp_extract(body, '^(.*)@[^@]*$', 1) ELSE body END AS path,
 CASE WHEN type IS NULL THEN NULL WHEN contains(body, '@') THEN nullif(regexp_extract(body, '@([^@]*)$', 1), '') ELSE nullif(regexp_extract(rest, '^[^@?]*\?.*@([^@=&/]+)$', 1), '') END AS version FROM u""")
def _(df):
    return df.select("k", *[c.alias(n) for n, c in P.parse("raw").items()])


@query("purl_coordinate", PURLS, "SELECT k, CASE WHEN contains(raw, '@') THEN regexp_extract(raw, '^(.*)@[^@]*$', 1) ELSE raw END AS coordinate FROM inp")
def _(df):
    return df.select("k", P.coordinate("raw").alias("coordinate"))


@query("purl_pep503", "SELECT p_partkey AS k, replace(p_name, ' ', CASE p_partkey % 4 WHEN 0 THEN '_' WHEN 1 THEN '--' WHEN 2 THEN '._' ELSE '.' END) AS raw FROM {part}", "SELECT k, lower(regexp_replace(raw, '[-_.]+', '-', 'g')) AS name FROM inp")
def _(df):
    return df.select("k", P.normalize_pypi("raw").alias("name"))


@query("goproxy_escape", "SELECT p_partkey AS k, 'github.com/' || p_brand || '/' || replace(p_type, ' ', '-') AS raw FROM {part}", r"SELECT k, lower(regexp_replace(raw, '([A-Z])', '!\1', 'g')) AS escaped, raw AS back FROM inp")
def _(df):
    e = P.goproxy_escape("raw")
    return df.select("k", e.alias("escaped"), P.goproxy_unescape(e).alias("back"))


_PAGES = "SELECT page_id AS k, CASE page_id % 5 WHEN 0 THEN replace(url, '.example', '.example:8080') WHEN 1 THEN url || '?a=1#f' WHEN 2 THEN 'ftp' || url ELSE url END AS url FROM (SELECT page_id, url FROM {pages}) p"


@query("url_split_host", _PAGES, r"SELECT k, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_extract(url, '^https?://([^/:]*)', 1) END AS host, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_extract(url, '^https?://[^/]*/?([^?#]*)', 1) END AS path, regexp_matches(url, '^(?i:https?)://') AS web FROM inp")
def _(df):
    return df.select("k", P.split_host("url").alias("host"), P.split_path("url").alias("path"), P.is_web_scheme("url").alias("web"))


_ARTIFACTS = f"""SELECT p_partkey AS k, CASE p_partkey % 9
  WHEN 0 THEN 'https://registry.npmjs.org/@s/' || {_SLUG} || '/-/' || {_SLUG} || '-1.' || p_size || '.tgz'
  WHEN 1 THEN 'https://static.crates.io/crates/' || {_SLUG} || '/' || {_SLUG} || '-0.' || p_size || '.crate'
  WHEN 2 THEN 'https://files.pythonhosted.org/packages/ab/' || {_SLUG} || '-1.' || p_size || '-py3-none-any.whl'
  WHEN 3 THEN 'https://rubygems.org/downloads/' || {_SLUG} || '-2.' || p_size || '.gem'
  WHEN 4 THEN 'https://proxy.golang.org/github.com/!big/' || {_SLUG} || '/@v/v1.' || p_size || '.zip'
  WHEN 5 THEN 'https://API.nuget.org/v3-flatcontainer/' || {_SLUG} || '/' || p_size || '/x.nupkg'
  WHEN 6 THEN 'https://repo1.maven.org/maven2/org/acme/' || {_SLUG} || '/' || p_size || '/a.jar'
  WHEN 7 THEN 'https://codeload.github.com/acme/' || {_SLUG} || '/tar.gz/v' || p_size
  ELSE 'https://example.com/' || {_SLUG} END AS url FROM {{part}}"""


@query("url_to_purl", _ARTIFACTS, r"""
, a AS (SELECT k, url, lower(regexp_extract(url, '^https?://([^/:]*)', 1)) AS h, regexp_extract(url, '^https?://[^/]*/?([^?#]*)', 1) AS p FROM inp)
SELECT k, CASE h
  WHEN 'registry.npmjs.org' THEN 'pkg:npm/' || replace(regexp_extract(p, '^(.*?)/-/', 1), '@', '%40') || '@' || regexp_extract(p, '-([^-]*)\.tgz$', 1)
  WHEN 'static.crates.io' THEN 'pkg:cargo/' || regexp_extract(p, '^crates/([^/]*)/', 1) || '@' || regexp_extract(p, '-([^-]*)\.crate$', 1)
  WHEN 'files.pythonhosted.org' THEN 'pkg:pypi/' || lower(regexp_replace(regexp_extract(p, '([^/-]*)-[^/-]*-py3-none-any\.whl$', 1), '[-_.]+', '-', 'g')) || '@' || regexp_extract(p, '-([^/-]*)-py3-none-any\.whl$', 1)
  WHEN 'rubygems.org' THEN 'pkg:gem/' || regexp_extract(p, '^downloads/(.*)-[0-9]', 1) || '@' || regexp_extract(p, '-([0-9][^-]*)\.gem$', 1)
  WHEN 'proxy.golang.org' THEN 'pkg:golang/' || replace(regexp_extract(p, '^(.*)/@v/', 1), '!b', 'B') || '@' || regexp_extract(p, '/@v/(.*)\.zip$', 1)
  WHEN 'api.nuget.org' THEN 'pkg:nuget/' || regexp_extract(p, '^v3-flatcontainer/([^/]*)', 1) || '@' || regexp_extract(p, '^v3-flatcontainer/[^/]*/([^/]*)', 1)
  WHEN 'repo1.maven.org' THEN 'pkg:maven/org.acme/' || split_part(p, '/', 4) || '@' || split_part(p, '/', 5)
  WHEN 'codeload.github.com' THEN 'pkg:github/' || split_part(p, '/', 1) || '/' || split_part(p, '/', 2) || '@' || split_part(p, '/', 4) END AS purl FROM a""")
def _(df):
    return P.url_to_purl(df, "url").select("k", "purl")


_VERSIONED = f"""SELECT p_partkey AS k, CASE p_partkey % 6
  WHEN 0 THEN 'pkg:npm/%40s/' || {_SLUG} || '@1.' || p_size WHEN 1 THEN 'pkg:cargo/' || {_SLUG} || '@0.' || p_size WHEN 2 THEN 'pkg:gem/' || {_SLUG} || '@2.' || p_size
  WHEN 3 THEN 'pkg:golang/github.com/Big/' || {_SLUG} || '@v1.' || p_size WHEN 4 THEN 'pkg:nuget/' || {_SLUG} || '@3.' || p_size ELSE 'pkg:github/acme/' || {_SLUG} || '@v' || p_size END AS purl FROM {{part}}"""


@query("purl_url_roundtrip", _VERSIONED, "SELECT k, purl AS back FROM inp")
def _(df):
    return P.url_to_purl(df.withColumn("url", resolve.resolve_purl("purl", decode=False)), "url", "back").select("k", "back")


_RESOLVE = f"""SELECT p_partkey AS k, CASE p_partkey % 11
  WHEN 0 THEN 'pkg:npm/%40s/' || {_SLUG} || '@1.' || p_size WHEN 1 THEN 'pkg:cargo/' || {_SLUG} || '@0.' || p_size WHEN 2 THEN 'pkg:gem/' || {_SLUG}
  WHEN 3 THEN 'pkg:golang/github.com/Big/' || {_SLUG} || '@v1.' || p_size WHEN 4 THEN 'pkg:nuget/' || upper({_SLUG}) || '@3.B' WHEN 5 THEN 'pkg:github/acme/' || {_SLUG}
  WHEN 6 THEN 'pkg:maven/org.acme/' || {_SLUG} || '@1?type=war&classifier=src' WHEN 7 THEN 'pkg:chrome/' || {_SLUG} WHEN 8 THEN 'pkg:clawhub/own/' || {_SLUG} || '@' || p_size
  WHEN 9 THEN 'pkg:npm/../' || {_SLUG} || '@1' ELSE 'pkg:cargo/a b@1' END AS purl FROM {{part}}"""


@query("resolve_urls", _RESOLVE, r"""
, a AS (SELECT k, regexp_extract(purl, '^pkg:([^/]*)/', 1) AS ty, regexp_extract(purl, '^pkg:[^/]*/([^@?]*)', 1) AS p, nullif(regexp_extract(purl, '@([^@?]*)', 1), '') AS v FROM inp)
SELECT k, CASE WHEN contains(p, '..') OR contains(p, ' ') THEN NULL ELSE CASE ty
  WHEN 'npm' THEN 'https://registry.npmjs.org/' || replace(p, '%40', '@') || '/-/' || regexp_extract(p, '([^/]*)$', 1) || '-' || v || '.tgz'
  WHEN 'cargo' THEN 'https://static.crates.io/crates/' || p || '/' || p || '-' || v || '.crate'
  WHEN 'gem' THEN 'https://rubygems.org/downloads/' || p || '-' || v || '.gem'
  WHEN 'golang' THEN 'https://proxy.golang.org/' || lower(regexp_replace(p, '([A-Z])', '!\1', 'g')) || '/@v/' || v || '.zip'
  WHEN 'nuget' THEN 'https://api.nuget.org/v3-flatcontainer/' || lower(p) || '/' || lower(v) || '/' || lower(p) || '.' || lower(v) || '.nupkg'
  WHEN 'github' THEN 'https://codeload.github.com/' || p || '/tar.gz/' || coalesce(v, 'HEAD')
  WHEN 'maven' THEN 'https://repo1.maven.org/maven2/org/acme/' || split_part(p, '/', 2) || '/' || v || '/' || split_part(p, '/', 2) || '-' || v || '-src.war'
  WHEN 'chrome' THEN 'https://clients2.google.com/service/update2/crx?response=redirect&prodversion=120&acceptformat=crx2,crx3&x=id%3D' || p || '%26installsource%3Dondemand%26uc'
  WHEN 'clawhub' THEN 'https://clawhub.ai/api/v1/download?slug=' || split_part(p, '/', 2) || '&ownerHandle=own&version=' || v END END AS url FROM a""")
def _(df):
    return df.select("k", resolve.resolve(F.lit("purl"), F.col("purl"), decode=False).alias("url"))


@query("resolve_oci", f"SELECT p_partkey AS k, 'pkg:docker/' || CASE p_partkey % 4 WHEN 0 THEN {_SLUG} WHEN 1 THEN 'acme/' || {_SLUG} || '@sha256:ab' WHEN 2 THEN 'ghcr.io/a/' || {_SLUG} || '@1.2' ELSE 'a/' || {_SLUG} || '?tag=x' END AS purl FROM {{part}}", r"""
, a AS (SELECT k, regexp_extract(purl, '^pkg:docker/([^@?]*)', 1) AS n, nullif(regexp_extract(purl, '@([^?]*)', 1), '') AS v, nullif(regexp_extract(purl, '[?&]tag=([^&]*)', 1), '') AS g FROM inp)
SELECT k, 'oci://' || CASE WHEN NOT contains(n, '/') THEN 'docker.io/library/' WHEN regexp_matches(split_part(n, '/', 1), '[.:]') THEN '' ELSE 'docker.io/' END || n || CASE WHEN v LIKE 'sha256:%' THEN '@' ELSE ':' END || coalesce(v, g, 'latest') AS url FROM a""")
def _(df):
    return df.select("k", resolve.resolve(F.lit("purl"), F.col("purl"), decode=False).alias("url"))


_SHELL = r"""SELECT o_orderkey AS file_id, 'shell' AS file_type, CASE o_orderkey % 8
  WHEN 0 THEN 'npm install -g pkg' || o_custkey || '@1.0 --save; echo done' WHEN 1 THEN 'sudo apt-get install -y lib' || o_custkey || '=2.1 > log' WHEN 2 THEN 'pip install Pkg' || o_custkey || '[x]==3.0 && true'
  WHEN 3 THEN 'cargo install crate' || o_custkey || '@0.1' WHEN 4 THEN 'go get github.com/a/m' || o_custkey || '@v1' WHEN 5 THEN 'composer require ven/p' || o_custkey || ':^1'
  WHEN 6 THEN 'brew install f' || o_custkey || ' | tee x' ELSE 'echo nothing install' END AS text FROM {orders}"""


@query("cmd_install_refs", _SHELL, """
SELECT file_id, CASE file_id % 8 WHEN 0 THEN 'pkg:npm/' || regexp_extract(text, '(pkg[0-9]+@1.0)', 1) WHEN 1 THEN 'pkg:debian/' || replace(regexp_extract(text, '(lib[0-9]+=2.1)', 1), '=', '@')
  WHEN 2 THEN 'pkg:pypi/' || regexp_extract(text, '(Pkg[0-9]+)', 1) || '@3.0' WHEN 3 THEN 'pkg:cargo/' || regexp_extract(text, '(crate[0-9]+@0.1)', 1) WHEN 4 THEN 'pkg:golang/' || regexp_extract(text, '(github.com/a/m[0-9]+@v1)', 1)
  WHEN 5 THEN 'pkg:composer/' || regexp_extract(text, '(ven/p[0-9]+)', 1) ELSE 'pkg:homebrew/' || regexp_extract(text, '(f[0-9]+)', 1) END AS locator FROM inp WHERE file_id % 8 <> 7""", spread="orders")
def _(df):
    return recognize.commands(df).select("file_id", "locator")


_DOCKER = """SELECT l_orderkey AS file_id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CASE WHEN l_partkey % 5 = 0 THEN 'FROM ' || CASE l_suppkey % 4 WHEN 0 THEN 'ubuntu:22' WHEN 1 THEN 'cgr.dev/chainguard/x' WHEN 2 THEN 'scratch' ELSE 'alpine:3' END
  WHEN l_partkey % 2 = 0 THEN 'RUN apt-get install lib' || l_partkey ELSE 'RUN apk add lib' || l_partkey END AS line FROM {lineitem}"""


@query("dockerfile_distro", _DOCKER, """
, f AS (SELECT *, line LIKE 'FROM%' AS is_from, CASE WHEN line LIKE '%ubuntu%' THEN 'ubuntu' WHEN line LIKE '%chainguard%' THEN 'wolfi' WHEN line LIKE '%alpine%' THEN 'alpine' ELSE 'none' END AS d FROM inp),
g AS (SELECT *, last_value(CASE WHEN is_from THEN d END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY n, p, s ROWS UNBOUNDED PRECEDING) AS base FROM f)
SELECT file_id, CASE WHEN line LIKE '%apt-get%' THEN CASE WHEN base = 'ubuntu' THEN 'ubuntu' ELSE 'debian' END ELSE CASE WHEN base = 'wolfi' THEN 'wolfi' ELSE 'alpine' END END AS ecosystem, count(*) AS installs FROM g WHERE NOT is_from GROUP BY 1, 2""")
def _(df):
    files = df.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p", "s", "line"))), lambda x: x["line"]), "\n").alias("text")).withColumn("file_type", F.lit("dockerfile"))
    refs = recognize.commands(files)
    return refs.groupBy("file_id", F.regexp_extract("locator", "^pkg:([^/]*)/", 1).alias("ecosystem")).agg(F.count("*").alias("installs"))


_QUOTED = "SELECT page_id AS file_id, 'shell' AS file_type, 'x \"' || url || '\" (https://a.b/' || page_id || ') http:// git+https://git.example/r' || page_id || '.git' || chr(10) || 'git clone -q \"https://h.example/' || page_id || '.git\"' AS text FROM {pages}"


@query("url_extract", _QUOTED, r"""
SELECT file_id, locator FROM (SELECT file_id, unnest(regexp_extract_all(text, 'https?://[^\s"''|;`<>(),]*')) AS locator FROM inp) WHERE length(locator) > 8""")
def _(df):
    return recognize.urls(df).select("file_id", "locator")


@query("git_refs", _QUOTED, "SELECT file_id, 'https://git.example/r' || file_id AS locator FROM inp UNION ALL SELECT file_id, 'https://h.example/' || file_id FROM inp")
def _(df):
    return recognize.git_refs(df).select("file_id", "locator")


@query("dedup_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'pkg:x/' || (l_partkey % 50) AS locator FROM {lineitem}", "SELECT l_orderkey, locator, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, locator ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM inp) WHERE r = 1")
def _(df):
    return recognize.dedup_first(df, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "locator", "l_linenumber", "l_partkey")


@query("undeclared_packages", """SELECT 0 AS package_id, 'purl' AS locator_type, 'pkg:npm/p' || p_partkey || '@1' AS locator, 'dependency' AS kind FROM {part} WHERE p_size > 25
  UNION ALL SELECT 0, 'purl', 'pkg:npm/p' || l_partkey || '@' || l_linenumber, 'command' FROM {lineitem}""", """
SELECT regexp_extract(locator, '^(.*)@', 1) AS coordinate, count(*) AS hunted FROM inp i WHERE kind = 'command' AND NOT EXISTS (SELECT 1 FROM inp d WHERE d.kind = 'dependency' AND regexp_extract(d.locator, '^(.*)@', 1) = regexp_extract(i.locator, '^(.*)@', 1)) GROUP BY 1""")
def _(df):
    return recognize.undeclared_packages(df).groupBy("coordinate").agg(F.count("*").alias("hunted"))


@query("import_builtin_filter", "SELECT c_custkey AS k, CASE c_custkey % 2 WHEN 0 THEN 'npm' ELSE 'pypi' END AS eco, CASE c_custkey % 9 WHEN 0 THEN 'node:fs' WHEN 1 THEN 'os' WHEN 2 THEN './x' WHEN 3 THEN '@a/b' || c_custkey || '/deep' WHEN 4 THEN 'lodash/x' WHEN 5 THEN 'requests.api' WHEN 6 THEN 'https://e.com/' || c_custkey WHEN 7 THEN 'vscode' ELSE 'pkg' || c_custkey END AS spec FROM {customer}", r"""
SELECT k, locator FROM (SELECT k, CASE WHEN contains(spec, '://') THEN spec WHEN regexp_matches(spec, '^[./]') THEN NULL
  WHEN eco = 'npm' THEN CASE WHEN replace(spec, 'node:', '') IN ('fs', 'os', 'vscode') THEN NULL WHEN spec LIKE '@%' THEN 'pkg:npm/%40' || regexp_extract(spec, '^@([^/]*/[^/]*)', 1) ELSE 'pkg:npm/' || regexp_extract(spec, '^([^/]*)', 1) END
  ELSE CASE WHEN regexp_extract(spec, '^([^.:]*)', 1) IN ('os', 'node') AND spec <> 'node:fs' THEN NULL WHEN regexp_matches(regexp_extract(spec, '^([^.:]*)', 1), '^[A-Za-z0-9._-]+$') THEN 'pkg:pypi/' || regexp_extract(spec, '^([^.:]*)', 1) END END AS locator FROM inp) WHERE locator IS NOT NULL""")
def _(df):
    return df.withColumn("r", recognize._some(recognize.import_locator("eco", "spec"))).select("k", F.col("r.locator").alias("locator"))


_TIMES = "SELECT user_id AS package, event_id AS k, {epoch} AS t FROM {events}"


def _epoch(spark_side: bool) -> str:
    return _TIMES.replace("{epoch}", "unix_timestamp(CAST(ts AS TIMESTAMP))" if spark_side else "CAST(floor(epoch(ts)) AS BIGINT)")


def _timeline(spark, sf_dir):
    return registry.release_timeline(rows(spark, sf_dir, _epoch(True)), "package", "t")


QUERIES["release_timeline"] = _timeline
ORACLES["release_timeline"] = f"WITH inp AS ({_epoch(False).replace('{events}', 'events')}) SELECT package, k, t, count(*) OVER w AS release_count, min(t) OVER w AS first_published_at, max(t) OVER (PARTITION BY package ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_published_at FROM inp WINDOW w AS (PARTITION BY package)"


@query("pick_artifact", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'x-py3-none-any.whl' WHEN 'N' THEN 'x-cp3-none-any.whl' ELSE 'x-cp3-linux.whl' END AS filename FROM {lineitem}", "SELECT l_orderkey, filename, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN filename LIKE '%-py3-none-any.whl' THEN 0 WHEN filename LIKE '%-none-any.%' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey) AS r FROM inp) WHERE r = 1")
def _(df):
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    return ranking.best(df, ["l_orderkey"], ranking.wheel_rank("filename"), order).select("l_orderkey", "filename", "l_linenumber")


@query("version_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 4 AS want, l_linenumber % 4 AS have FROM {lineitem}", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(min(CASE WHEN have = 2 THEN l_partkey END) OVER w, first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) AS found FROM inp WINDOW w AS (PARTITION BY l_orderkey)")
def _(df):
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey")
    first = F.first("l_partkey").over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.min(F.when(F.col("have") == 2, F.col("l_partkey"))).over(w), first).alias("found"))


@query("json_fields", "SELECT event_id AS k, CASE event_id % 3 WHEN 0 THEN '{\"k\": \"t' || event_id || '\"}' WHEN 1 THEN props ELSE 'bad' END AS body FROM {events}", "SELECT k, CASE WHEN k % 3 = 0 THEN json_extract_string(body, '$.k') END AS text, CASE WHEN k % 3 = 1 THEN CAST(json_extract_string(body, '$.k') AS BIGINT) END AS number FROM inp")
def _(df):
    doc = F.try_parse_json("body")
    return df.select("k", jstr(doc, "$.k").alias("text"), ju64(doc, "$.k").alias("number"))


_STAMP = "SELECT o_orderkey AS k, substr('' || CAST(o_orderdate AS DATE), 1, 10) || CASE o_orderkey % 5 WHEN 0 THEN 'T10:20:30Z' WHEN 1 THEN ' 01:02:03.456+02:30' WHEN 2 THEN 'T23:59:59-0100' WHEN 3 THEN 'T00:00:00' ELSE 'T1x:00:00' END AS stamp FROM {orders}"


@query("rfc3339_parse", _STAMP, r"""
SELECT k, CASE k % 5 WHEN 4 THEN NULL ELSE CAST(epoch(CAST(substr(stamp, 1, 10) AS TIMESTAMP)) AS BIGINT) + CASE k % 5 WHEN 0 THEN 37230 WHEN 1 THEN 3723 - 9000 WHEN 2 THEN 86399 + 3600 ELSE 0 END END AS seconds FROM inp""", spread="orders")
def _(df):
    return df.select("k", S.rfc3339_seconds("stamp").alias("seconds"))


@query("month_day_year", "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM {orders}", "SELECT k, CAST(epoch(CAST(d AS TIMESTAMP)) AS BIGINT) AS seconds FROM inp")
def _(df):
    return df.select("k", S.month_day_year_seconds(F.date_format("d", "MMMM d, yyyy")).alias("seconds"))


@query("email_domain", "SELECT doc_id AS k, text FROM {documents} WHERE text LIKE '%@%'", r"SELECT k, lower(regexp_extract(m, '@([A-Za-z0-9.-]+)$', 1)) AS domain FROM (SELECT k, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS m FROM inp)")
def _(df):
    return df.select("k", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), 0)).alias("m")).select("k", S.email_domain("m").alias("domain"))


@query("stanza_apk", "SELECT p_partkey AS k, 'P:' || replace(p_name, ' ', '-') || chr(10) || 'V:1.' || p_size || '-r0' || chr(10) || 'T:' || p_type || chr(10) || 't:' || (p_partkey * 1000) || chr(10) || 'L:MIT' AS body FROM {part}", r"""
SELECT k, regexp_extract(body, '(?m)^P:(.*)$', 1) AS name, regexp_extract(body, '(?m)^V:(.*)$', 1) AS version, CAST(regexp_extract(body, '(?m)^t:(.*)$', 1) AS BIGINT) AS published_at, regexp_extract(body, '(?m)^T:(.*)$', 1) AS description, 'MIT' AS license FROM inp""")
def _(df):
    f = lambda k: S.stanza_field("body", k)
    return df.select("k", f("P:").alias("name"), f("V:").alias("version"), f("t:").try_cast("bigint").alias("published_at"), f("T:").alias("description"), f("L:").alias("license"))


@query("html_meta", "SELECT page_id AS k, '<meta property=\"og:title\" content=\"Page ' || page_id || '\">' || substr(html, 1, 600) || '<b>Updated</b><i> March ' || (1 + page_id % 28) || ', 2024</i> 1,' || (100 + page_id % 900) || ' users' AS html FROM {pages}", r"""
SELECT k, 'Page ' || k AS title, CAST(epoch(TIMESTAMP '2024-03-01 00:00:00') AS BIGINT) + (k % 28) * 86400 AS updated, 1000 + 100 + k % 900 AS users FROM inp""")
def html_meta(df):
    return df.select("k", S.meta_content("html", "og:title").alias("title"), S.month_day_year_seconds(S.text_after("html", "Updated")).alias("updated"), S.grouped_number(S.number_before("html", " users")).alias("users"))


def whole_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, html): all of every page between the markers that the SQL plants around its first characters."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    before = F.format_string('<meta property="og:title" content="Page %d">', "page_id")
    after = F.format_string("<b>Updated</b><i> March %d, 2024</i> 1,%d users", 1 + F.col("page_id") % 28, 100 + F.col("page_id") % 900)
    return pages.select(F.col("page_id").alias("k"), F.concat(before, "html", after).alias("html"))


QUERIES["html_meta"] = lambda spark, sf_dir: html_meta(whole_pages(spark, sf_dir))


@query("ssrf_v4", "SELECT o_orderkey AS k, (o_orderkey * 7 % 256) || '.' || (o_custkey * 13 % 260) || '.' || (o_orderkey % 256) || '.1' AS ip FROM {orders}", r"""
, a AS (SELECT k, ip, CAST(split_part(ip, '.', 1) AS INT) AS a, CAST(split_part(ip, '.', 2) AS INT) AS b, CAST(split_part(ip, '.', 3) AS INT) AS c FROM inp)
SELECT k, CASE WHEN b > 255 THEN NULL ELSE a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) END AS blocked FROM a""")
def _(df):
    return df.select("k", S.blocked_ipv4("ip").alias("blocked"))


@query("pin_verify", "SELECT doc_id AS k, text, doc_id % 7 = 0 AS bad FROM {documents} WHERE text IS NOT NULL", "SELECT k, NOT bad AS verified, sha256(text) AS content_sha256 FROM inp")
def _(df):
    pin = F.when(F.col("bad"), F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.upper(F.sha2("text", 256)))
    return df.select("k", fetching.verify_pin(F.lit("sha256"), pin, "text").alias("verified"), S.sha256_hex("text").alias("content_sha256"))


@query("fetch_select", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 3 WHEN 0 THEN 'purl' WHEN 1 THEN 'url' ELSE 'path' END AS locator_type, CASE l_returnflag WHEN 'A' THEN 'dependency' WHEN 'N' THEN 'url_fetch' ELSE 'command' END AS kind, l_linestatus = 'O' AS target FROM {lineitem}", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM inp WHERE target AND (locator_type = 'purl' OR (locator_type = 'url' AND kind IN ('dependency', 'command')))")
def _(df):
    return df.where(fetching.selected("locator_type", "kind", "target")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("budget_claim", "SELECT l_suppkey AS source, l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS size, l_linestatus = 'O' AS miss FROM {lineitem}", """
, a AS (SELECT *, NOT miss OR sum(CASE WHEN miss THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) <= 20 AS claimed FROM inp)
SELECT source, l_orderkey, l_linenumber, l_partkey, claimed, coalesce(sum(CASE WHEN claimed THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5000 AS within_bytes FROM a""")
def _(df):
    return fetching.claim(df, ["l_orderkey", "l_linenumber", "l_partkey"], ["source"], 20, 5000).select("source", "l_orderkey", "l_linenumber", "l_partkey", "claimed", "within_bytes")


@query("cache_lifetimes", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey * 60 AS age, l_returnflag = 'A' AS pinned FROM {lineitem}", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, age <= CASE WHEN pinned THEN 604800 ELSE 43200 END AS fresh FROM inp")
def _(df):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fetching.is_fresh(F.lit(0), "age", fetching.artifact_lifetime("pinned")).alias("fresh"))


_LAYERS = "SELECT l_orderkey % 2000 AS image, l_linenumber AS layer_no, l_orderkey, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' AND l_partkey % 3 = 0 THEN 'd' || (l_partkey % 5) || '/.wh.f' || (l_suppkey % 4) WHEN l_returnflag = 'A' AND l_partkey % 7 = 0 THEN 'd' || (l_partkey % 5) || '/.wh..wh..opq' ELSE './d' || (l_partkey % 5) || '/f' || (l_suppkey % 4) END AS path FROM {lineitem}"


@query("layer_flatten", _LAYERS, r"""
, c AS (SELECT image, layer_no, l_orderkey, l_partkey, l_suppkey, regexp_replace(path, '^\./', '') AS path FROM inp),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, path ORDER BY layer_no DESC, l_orderkey, l_partkey, l_suppkey) AS r FROM c WHERE NOT contains(path, '.wh.')) WHERE r = 1)
SELECT t.image, t.path, t.layer_no, t.l_partkey FROM top t WHERE NOT EXISTS (SELECT 1 FROM c m WHERE m.image = t.image AND m.layer_no > t.layer_no AND contains(m.path, '.wh.')
  AND CASE WHEN m.path LIKE '%/.wh..wh..opq' THEN split_part(m.path, '/', 1) = split_part(t.path, '/', 1) ELSE replace(m.path, '.wh.', '') = t.path END)""")
def _(df):
    return layers.flatten(df, entry=["l_orderkey", "l_partkey", "l_suppkey"]).select("image", "path", "layer_no", "l_partkey")


@query("cache_evict", "SELECT o_custkey % 20 AS component, '' || o_orderkey AS path, o_orderkey AS modified, CAST(o_totalprice AS BIGINT) AS bytes FROM {orders}", """
, s AS (SELECT *, (SELECT max(modified) FROM inp) - modified > 12000 AS old FROM inp),
r AS (SELECT *, sum(CASE WHEN old THEN 0 ELSE bytes END) OVER (PARTITION BY component) AS total, coalesce(sum(CASE WHEN old THEN 0 ELSE bytes END) OVER (PARTITION BY component ORDER BY modified, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM s)
SELECT component, path, CASE WHEN old THEN 'age' WHEN total > 20000000 AND total - gone > 18000000 THEN 'size' END AS evicted_by FROM r""")
def _(df):
    last = df.agg(F.max("modified").alias("__now"))
    return sweep.evict(df.crossJoin(F.broadcast(last)), F.col("__now"), max_age=12000, max_bytes=20_000_000).select("component", "path", "evicted_by")


_CRATES = "SELECT p_partkey AS k, replace(p_name, ' ', '-') AS name, CASE p_partkey % 2 WHEN 0 THEN '1.0' END AS version, '{\"crate\": {\"max_stable_version\": \"2.0\", \"description\": \"' || p_type || '\", \"downloads\": ' || p_size || '}, \"versions\": [{\"num\": \"1.0\", \"created_at\": \"2024-01-02T03:04:05Z\", \"license\": \"MIT\", \"yanked\": true}, {\"num\": \"2.0\", \"created_at\": \"2024-02-02T00:00:00Z\", \"license\": \"BSD\", \"yanked\": false}]}' AS body FROM {part}"


@query("registry_crates", _CRATES, """
, v AS (SELECT *, CASE WHEN version IS NULL THEN 1 ELSE 0 END AS i FROM inp)
SELECT 'crates' AS ecosystem, name, coalesce(version, '2.0') AS version, CAST(epoch(CAST(replace(json_extract_string(body, '$.versions[' || i || '].created_at'), 'Z', '') AS TIMESTAMP)) AS BIGINT) AS published_at, '2.0' AS latest_version, json_extract_string(body, '$.crate.description') AS description,
 json_extract_string(body, '$.versions[' || i || '].license') AS license, CAST(json_extract_string(body, '$.crate.downloads') AS BIGINT) AS downloads_total, CASE WHEN i = 0 THEN 'yanked' END AS deprecated FROM v""", spread="part")
def _(df):
    return registry.normalize(df, "cargo").select("ecosystem", "name", "version", "published_at", "latest_version", "description", "license", "downloads_total", "deprecated")


_NPM = "SELECT p_partkey AS k, 'p' || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN '1.0.0' WHEN 1 THEN '9.9.9' END AS version, '{\"dist-tags\": {\"latest\": \"1.1.0\"}, \"time\": {\"created\": \"2020-01-01T00:00:00Z\", \"modified\": \"2024-01-01T00:00:00Z\", \"1.0.0\": \"2020-01-01T00:00:00Z\", \"1.1.0\": \"2021-01-01T00:00:00Z\", \"9.9.9\": \"2022-01-01T00:00:00Z\"}, \"maintainers\": [{\"name\": \"a' || p_size || '\"}], \"versions\": {\"1.0.0\": {\"license\": \"MIT\", \"_npmUser\": {\"name\": \"a' || p_size || '\", \"email\": \"X@Mail.Example\"}, \"scripts\": {\"install\": \"x\"}}, \"1.1.0\": {\"license\": \"ISC\", \"dist\": {\"unpackedSize\": ' || p_partkey || '}}}}' AS body FROM {part}"


@query("registry_npm", _NPM, """
SELECT name, coalesce(version, '1.1.0') AS version, CASE WHEN version = '1.0.0' THEN 1577836800 WHEN version = '9.9.9' THEN 1640995200 ELSE 1609459200 END AS published_at, CAST(3 AS BIGINT) AS release_count,
 CASE WHEN version = '1.0.0' THEN NULL WHEN version = '9.9.9' THEN 1609459200 ELSE 1577836800 END AS previous_published_at, CASE WHEN version = '1.0.0' THEN 'MIT' WHEN version IS NULL THEN 'ISC' END AS license, coalesce(version, '') = '9.9.9' AS version_removed,
 CASE WHEN version = '1.0.0' THEN true END AS publisher_in_maintainers, CASE WHEN version = '1.0.0' THEN 'mail.example' END AS publisher_email_domain, CASE WHEN version = '1.0.0' THEN true WHEN version IS NULL THEN false END AS has_install_script, CASE WHEN version IS NULL THEN k END AS unpacked_size FROM inp""", spread="part")
def _(df):
    return registry.normalize(df, "npm").select("name", "version", "published_at", "release_count", "previous_published_at", "license", "version_removed", "publisher_in_maintainers", "publisher_email_domain", "has_install_script", "unpacked_size")


@query("registry_homebrew", "SELECT p_partkey AS k, replace(p_name, ' ', '-') AS name, CAST(NULL AS STRING) AS version, '{\"name\": \"f' || p_partkey || '\", \"versions\": {\"stable\": \"' || p_size || '\"}, \"analytics\": {\"install\": {\"30d\": {\"a\": ' || p_size || ', \"b\": 5}}}, \"deprecated\": false, \"disabled\": ' || CASE p_partkey % 2 WHEN 0 THEN 'true' ELSE 'false' END || '}' AS body FROM {part}", "SELECT 'f' || k AS name, json_extract_string(body, '$.versions.stable') AS version, CAST(json_extract_string(body, '$.versions.stable') AS BIGINT) + 5 AS downloads_recent, CASE WHEN k % 2 = 0 THEN 'disabled' END AS deprecated FROM inp", spread="part")
def _(df):
    return registry.normalize(df, "homebrew").select("name", "version", "downloads_recent", "deprecated")


@query("ssrf_v6", """SELECT o_orderkey AS k, CASE o_orderkey % 14 WHEN 0 THEN '2001:0:4136:e378::1' WHEN 1 THEN '64:ff9b:1::' || (o_custkey % 9) WHEN 2 THEN '64:ff9b::a00:1' WHEN 3 THEN '64:ff9b::808:808' WHEN 4 THEN '2606:4700::' || (o_custkey % 9) WHEN 5 THEN '::ffff:10.0.0.' || (o_custkey % 9)
  WHEN 6 THEN '::ffff:8.8.8.' || (o_custkey % 9) WHEN 7 THEN 'fe80::' || (o_custkey % 9) WHEN 8 THEN 'fd00::1' WHEN 9 THEN '2002:7f00:1::' WHEN 10 THEN '2002:808:808::' WHEN 11 THEN '::1' WHEN 12 THEN '64:ff9b:0:1::a00:1' ELSE 'no address' END AS ip FROM {orders}""",
  "SELECT k, CASE WHEN k % 14 IN (0, 1, 2, 5, 7, 8, 9, 11, 12) THEN true WHEN k % 14 IN (3, 4, 6, 10) THEN false END AS blocked FROM inp")
def _(df):
    return df.select("k", S.blocked_ip("ip").alias("blocked"))


@query("percent_decode", "SELECT p_partkey AS k, 'v%2F' || p_partkey || '%zz%C3%A9+%e4%b8%ad%' AS text FROM {part}", "SELECT k, 'v/' || k || '%zzé+中%' AS decoded FROM inp")
def _(df):
    return df.select("k", S.percent_decoded("text").alias("decoded"))


@query("path_clean", "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN './a//b' || p_size WHEN 1 THEN '../../a/./c' || p_size WHEN 2 THEN '/x/../y' || p_size || '/' WHEN 3 THEN '..' ELSE 'a/b/../../c' || p_size END AS path FROM {part}",
  "SELECT k, CASE k % 5 WHEN 0 THEN 'a/b' WHEN 1 THEN 'a/c' WHEN 2 THEN 'y' WHEN 3 THEN '' ELSE 'c' END || CASE WHEN k % 5 = 3 THEN '' ELSE regexp_extract(path, '([0-9]+)/?$', 1) END AS path FROM inp")
def _(df):
    return df.select("k", layers.clean_path("path").alias("path"))


@query("stanza_deb", "SELECT s_suppkey AS k, 'Package: a' || s_suppkey || chr(10) || 'Version: 1-' || s_nationkey || chr(10) || chr(10) || chr(10) || 'Package: b' || s_suppkey || chr(10) || 'Version: 2' || chr(10) || 'Maintainer: M' || s_suppkey || ' <m@x.y>' || chr(10) AS body, s_nationkey AS n FROM {supplier}", """
SELECT k, 'a' || k AS name, '1-' || n AS version, CAST(NULL AS VARCHAR) AS author FROM inp UNION ALL SELECT k, 'b' || k, '2', 'M' || k FROM inp""")
def _(df):
    f = lambda k: S.stanza_field("stanza", k)
    return readers.split_stanzas(df, "body").select("k", f("Package:").alias("name"), f("Version:").alias("version"), S.strip_email(f("Maintainer:")).alias("author"))


@query("rpm_xml", """SELECT s_suppkey AS k, '<metadata><package type="rpm"><name>a' || s_suppkey || '</name><version ver="1" rel="' || s_nationkey || '"/></package><package><name>b&amp;' || s_suppkey || '</name><version ver="2" rel="0"/></package></metadata>' AS body, s_nationkey AS n FROM {supplier}""", """
SELECT k, 'a' || k AS name, '' || n AS release FROM inp UNION ALL SELECT k, 'b&' || k, '0' FROM inp""")
def _(df):
    return readers.split_elements(df, "body").select("k", S.tag_text("element", "name").alias("name"), S.tag_attribute("element", "version", "rel").alias("release"))


@query("ndjson", "SELECT event_id AS k, props || chr(10) || 'not json' || chr(10) || chr(10) || '{\"k\": ' || event_id || '}' AS body FROM {events}", "SELECT k, CAST(json_extract_string(split_part(body, chr(10), 1), '$.k') AS BIGINT) AS number, CAST(0 AS INTEGER) AS pos FROM inp UNION ALL SELECT k, k, 3 FROM inp")
def _(df):
    return readers.json_lines(df, "body").select("k", ju64(F.try_parse_json("line"), "$.k").alias("number"), "pos")


@query("listing", "SELECT s_suppkey AS k, ' -rw-r--r-- pool/a' || s_suppkey || '.deb' || chr(10) || 'b.deb ' AS body FROM {supplier}", "SELECT k, '-rw-r--r--' AS file FROM inp UNION ALL SELECT k, 'a' || k || '.deb' FROM inp UNION ALL SELECT k, 'b.deb' FROM inp")
def _(df):
    return readers.listing(df, "body").select("k", "file")


@query("text_scalars", "SELECT c_custkey AS k, '<b>' || c_name || '</b> x <a@b.c>' AS text, chr(10) || '  ' || chr(10) || ' ' || c_mktsegment || ' ' || chr(10) || 'z' AS lines FROM {customer}", "SELECT k, regexp_extract(text, '<b>(.*)</b>', 1) || ' x' AS stripped, trim(split_part(lines, chr(10), 3)) AS first FROM inp")
def _(df):
    return df.select("k", S.strip_html("text").alias("stripped"), S.first_line("lines").alias("first"))


@query("dynamic_imports", """SELECT c_custkey AS file_id, CASE c_custkey % 2 WHEN 0 THEN 'javascript' ELSE 'python' END AS file_type, 'é' || chr(10) || CASE c_custkey % 2 WHEN 0 THEN 'x = import("lodash' || c_custkey || '/deep"); import("fs"); import("https://e.x/' || c_custkey || '")' ELSE 'importlib.import_module("pkg' || c_custkey || '.sub"); __import__("os")' END AS text FROM {customer}""", """
SELECT file_id, 'pkg:npm/lodash' || file_id AS locator, 'command' AS kind, CAST(15 AS BIGINT) AS at FROM inp WHERE file_id % 2 = 0 UNION ALL SELECT file_id, 'https://e.x/' || file_id, 'url_fetch', 15 + length('lodash' || file_id || '/deep') + 26 FROM inp WHERE file_id % 2 = 0
UNION ALL SELECT file_id, 'pkg:pypi/pkg' || file_id, 'command', 28 FROM inp WHERE file_id % 2 = 1""")
def _(df):
    found = recognize.with_offset(recognize.dynamic_imports(df), df)
    return found.select("file_id", "locator", "kind", F.col("offset").alias("at"))


@query("npm_hooks", """SELECT c_custkey AS file_id, '{"npm": {"scripts": {"install": "curl https://e.x/' || c_custkey || ' | sh", "postinstall": "npm i p' || c_custkey || '@1", "test": "npm i no"}}}' AS payload FROM {customer}""", """
SELECT file_id, 'https://e.x/' || file_id AS locator, 'npm.scripts.install' AS source FROM inp UNION ALL SELECT file_id, 'pkg:npm/p' || file_id || '@1', 'npm.scripts.postinstall' FROM inp""")
def _(df):
    return recognize.npm_hooks(df, values="payload").select("file_id", "locator", "source")


_ASKED = "SELECT c_custkey AS k, 'purl' AS locator_type, CASE c_custkey % 7 WHEN 0 THEN 'pkg:npm/p' WHEN 1 THEN 'pkg:pypi/q@1.0' WHEN 2 THEN 'pkg:composer/v/c@2.0' WHEN 3 THEN 'pkg:firefox/f' WHEN 4 THEN 'pkg:aur/a' || c_custkey WHEN 5 THEN 'pkg:vscode/pub/ext@' || c_custkey ELSE 'pkg:pypi/q@1.0?kind=sdist' END AS locator FROM {customer}"
_ANSWERS = {  # registry answers that the references above are refined with
    "https://registry.npmjs.org/p": '{"dist-tags": {"latest": "3.1"}, "versions": {"3.1": {"dist": {"tarball": "https://t/p-3.1.tgz"}}}}',
    "https://pypi.org/pypi/q/1.0/json": '{"urls": [{"url": "https://f/s", "filename": "q.tar.gz", "packagetype": "sdist"}, {"url": "https://f/l", "filename": "q-cp3-linux.whl", "packagetype": "bdist_wheel"}, {"url": "https://f/n", "filename": "q-cp3-none-any.whl", "packagetype": "bdist_wheel"}, {"url": "https://f/w", "filename": "q-py3-none-any.whl", "packagetype": "bdist_wheel"}]}',
    "https://repo.packagist.org/p2/v/c.json": '{"packages": {"v/c": [{"version": "v1.0", "dist": {"url": "https://c/1"}}, {"version": "v2.0", "dist": {"url": "https://c/2"}}]}}',
    "https://addons.mozilla.org/api/v5/addons/addon/f/": '{"current_version": {"version": "9", "file": {"url": "https://x/f.xpi"}}}',
}


def _with_documents(spark, sf_dir):
    documents = spark.createDataFrame(list(_ANSWERS.items()), "url string, body string")
    return resolve.resolve_with_documents(rows(spark, sf_dir, _ASKED), documents).select("k", "resolved_locator", "resolved_url")


QUERIES["resolve_documents"] = _with_documents
ORACLES["resolve_documents"] = f"""WITH inp AS ({_ASKED.replace('{customer}', 'customer')}) SELECT k, CASE k % 7 WHEN 0 THEN 'pkg:npm/p@3.1' WHEN 3 THEN 'pkg:firefox/f@9' ELSE locator END AS resolved_locator,
 CASE k % 7 WHEN 0 THEN 'https://t/p-3.1.tgz' WHEN 1 THEN 'https://f/w' WHEN 2 THEN 'https://c/2' WHEN 3 THEN 'https://x/f.xpi' WHEN 4 THEN 'https://aur.archlinux.org/cgit/aur.git/snapshot/a' || k || '.tar.gz'
 WHEN 5 THEN 'https://pub.gallery.vsassets.io/_apis/public/gallery/publisher/pub/extension/ext/' || k || '/assetbyname/Microsoft.VisualStudio.Services.VSIXPackage' ELSE 'https://f/s' END AS resolved_url FROM inp"""

#: n is the artifact's number; its cache entry, its answer and its pin follow from it.
_WANTED = "SELECT o_orderkey AS seq, 's' || (o_custkey % 50) AS source_sha256, 'url' AS locator_type, 'https://e.x/' || (o_orderkey % 300) AS locator, CASE WHEN o_orderkey % 11 > 0 THEN 'https://e.x/' || (o_orderkey % 300) END AS resolved_url, 'dependency' AS kind, o_orderkey % 7 > 0 AS is_target, CASE WHEN o_orderkey % 3 = 0 THEN 'sha256' END AS pin_algo, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN sha2('body' || (o_orderkey % 300), 256) ELSE repeat('0', 64) END END AS pin_value, o_orderkey % 300 AS n FROM {orders}"


def _outcomes(spark, sf_dir):
    wanted = rows(spark, sf_dir, _WANTED)
    artifacts = wanted.select("n").distinct().withColumns({"url": F.concat(F.lit("https://e.x/"), "n"), "body": F.concat(F.lit("body"), "n").cast("binary")})
    cache = artifacts.where("n % 5 < 2").select(fetching.artifact_key("url").alias("key"), F.when(F.col("n") % 5 == 0, 1_000_000).otherwise(0).cast("bigint").alias("fetched_at"), F.col("body").alias("content"))
    answers = artifacts.where("n % 4 < 3").select("url", F.lit(200).alias("status"), F.when(F.col("n") % 4 < 2, F.col("body")).alias("content"), F.when(F.col("n") % 4 == 2, "timeout").alias("error"))
    return fetching.fetch(wanted, cache, answers, 1_000_000, max_count=1 << 40, max_bytes=1 << 40).select("seq", "outcome", "failure", "cached", "stale", "pin_verified", "size")


QUERIES["fetch_outcome"] = _outcomes
ORACLES["fetch_outcome"] = f"""WITH inp AS ({_WANTED.replace('{orders}', 'orders').replace("sha2('body' || (o_orderkey % 300), 256)", "sha256('body' || (o_orderkey % 300))")}),
s AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'cache' WHEN n % 4 < 2 THEN 'network' WHEN n % 5 = 1 THEN 'stale' END AS served, CASE WHEN pin_algo IS NOT NULL THEN pin_value = sha256('body' || n) END AS pinned FROM inp),
o AS (SELECT *, CASE WHEN NOT is_target THEN 'skipped' WHEN resolved_url IS NULL THEN 'unresolved' WHEN served IS NULL THEN 'failed' WHEN pinned = false THEN 'pin_mismatch' ELSE 'ok' END AS outcome FROM s)
SELECT seq, outcome, CASE WHEN outcome = 'failed' THEN CASE WHEN n % 4 = 2 THEN 'timeout' ELSE 'no response' END END AS failure, coalesce(outcome IN ('ok', 'pin_mismatch') AND served <> 'network', false) AS cached, coalesce(outcome IN ('ok', 'pin_mismatch') AND served = 'stale', false) AS stale,
 CASE WHEN outcome IN ('ok', 'pin_mismatch') THEN pinned END AS pin_verified, CASE WHEN outcome IN ('ok', 'pin_mismatch') THEN CAST(length('body' || n) AS BIGINT) END AS size FROM o"""


#: Two documents a package: the first always answers, the second fails for every third one and is then held since long for every sixth.
_READS = "SELECT p_partkey AS k, 'n' || p_partkey AS name, CAST(NULL AS STRING) AS version, 'https://r/p' || (p_partkey % 50) AS u1, 'https://r/d' || p_partkey AS u2 FROM {part}"


def _sources(spark, sf_dir):
    asked = rows(spark, sf_dir, _READS).select("k", "name", "version", F.array("u1", "u2").alias("urls"))
    urls = asked.select("k", F.explode("urls").alias("url")).groupBy("url").agg(F.min("k").alias("k"))
    second, content = F.col("url").startswith("https://r/d"), F.concat(F.lit('{"id": "'), "url", F.lit('", "sha": "1"}')).cast("binary")
    down = second & (F.col("k") % 3 == 0)
    answers = urls.select("url", F.when(down, 503).otherwise(200).alias("status"), F.lit("application/json").alias("content_type"), F.when(~down, content).alias("content"), F.when(down, "status: 503").alias("error"))
    cache = urls.where(second & (F.col("k") % 6 == 0)).select(fetching.metadata_key("url").alias("key"), F.lit(0).cast("bigint").alias("fetched_at"), content.alias("content"), F.lit(203).alias("status"), F.lit("text/json").alias("content_type"))
    served = fetching.documents(urls.select("url", F.lit("unpinned").alias("tier")), cache, answers, 1_000_000)
    records, sources = registry.with_sources(asked, served, "huggingface", ("k",))
    return records.select("k", F.col("name").alias("record"), F.col("version").alias("record_version")).join(sources, "k").select("k", "record", "record_version", "pos", "url", "status", "content_type", F.octet_length("content").cast("bigint").alias("bytes"))


QUERIES["registry_sources"] = _sources
ORACLES["registry_sources"] = f"""WITH inp AS ({_READS.replace('{part}', 'part')}), d AS (SELECT k, u1, 0 AS pos, u1 AS url, 200 AS status, 'application/json' AS content_type FROM inp
 UNION ALL SELECT k, u1, 1, u2, CASE WHEN k % 6 = 0 THEN 203 ELSE 200 END, CASE WHEN k % 6 = 0 THEN 'text/json' ELSE 'application/json' END FROM inp WHERE k % 6 <> 3)
SELECT k, u1 AS record, '1' AS record_version, pos, url, status, content_type, CAST(length('{{"id": "' || url || '", "sha": "1"}}') AS BIGINT) AS bytes FROM d"""


FLAGSHIP = "SELECT o_orderkey % 100 AS package_id, o_orderkey AS file_id, 'dockerfile' AS file_type, 'FROM ' || CASE o_orderkey % 3 WHEN 0 THEN 'ubuntu:22.04' WHEN 1 THEN 'alpine:3' ELSE 'debian:12-slim' END || chr(10) || 'RUN apt-get install -y lib' || (o_custkey % 40) || ' && pip install p' || (o_custkey % 30) || '==1.0' || chr(10) || 'RUN npm i q' || (o_custkey % 20) AS text FROM {orders}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that a project's container files install and it doesn't declare, counted by ecosystem."""
    files = rows(spark, sf_dir, FLAGSHIP, "orders")
    files = files.groupBy("package_id", "file_type", "text").agg(F.min("file_id").alias("file_id"))  # equal files of a package name the same packages
    files = files.withColumn("file_id", F.struct("package_id", "file_id"))  # the package travels with its file
    refs = recognize.references(files, offsets=False).select("file_id.package_id", "locator_type", "locator", "kind")
    declared = rows(spark, sf_dir, "SELECT p_partkey % 100 AS package_id, 'purl' AS locator_type, 'pkg:pypi/p' || (p_partkey % 30) || '@2' AS locator, 'dependency' AS kind FROM {part}")
    found = recognize.undeclared_packages(refs, declared=declared)
    return found.groupBy(F.regexp_extract("locator", "^pkg:([^/]*)/", 1).alias("ecosystem")).agg(F.countDistinct("package_id", "coordinate").alias("packages"))


QUERIES["flagship"] = flagship
ORACLES["flagship"] = """WITH f AS (SELECT o_orderkey % 100 AS package_id, o_orderkey % 3 AS b, o_custkey AS c FROM orders),
r AS (SELECT package_id, CASE WHEN b = 0 THEN 'ubuntu' ELSE 'debian' END AS ecosystem, 'lib' || (c % 40) AS name FROM f UNION SELECT package_id, 'pypi', 'p' || (c % 30) FROM f UNION SELECT package_id, 'npm', 'q' || (c % 20) FROM f)
SELECT ecosystem, count(*) AS packages FROM r WHERE NOT (ecosystem = 'pypi' AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey % 100 = r.package_id AND 'p' || (p.p_partkey % 30) = r.name)) GROUP BY 1"""
for _cases in (registry_cases, lookup_cases, blank_cases, token_cases):
    QUERIES |= _cases.QUERIES
    ORACLES |= _cases.ORACLES
for _name, _sql in list(ORACLES.items()):
    ORACLES[_name] = _sql.replace("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)")
