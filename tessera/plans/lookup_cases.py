"""Queries that look packages up: through documents read in rounds, and in whole distribution indexes.

Answers and indexes are derived from ``part``; the packages asked for come from ``part`` and ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fetching, lookups, registry, resolve
from ..sources import readers

NOW = 1_000_000
DAY1, DAY2, DAY3 = 1704067200, 1704153600, 1704240000  # the first three days of 2024


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return readers.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def _serve(responses: DataFrame):
    """The metadata flow over an empty cache."""
    cache = responses.sparkSession.createDataFrame([], "key string, fetched_at bigint, content binary")
    return lambda requests: fetching.documents(requests.withColumn("tier", F.lit("unpinned")), cache, responses, NOW)


def _k(text: str):
    """``text`` with the key for ``@k``."""
    return F.replace(F.lit(text), F.lit("@k"), F.col("k").cast("string"))


_DAY = "2024-01-0{}T00:00:00Z"
_REG = "https://api.nuget.org/v3/registration5-gz-semver2/n@k/"


def _entry(version: str, day: int, more: str = "") -> str:
    return f'{{"catalogEntry": {{"version": "{version}", "published": "{_DAY.format(day)}"{more}}}}}'


#: (which keys modulo 8, URL, content, further condition on the key); the key stands for ``@k``.
ANSWERS = [
    (0, "https://registry.npmjs.org/@sc/p@k", '{"dist-tags": {"latest": "1.@k"}, "maintainers": [{"name": "a"}]}', None),
    (0, "https://api.npmjs.org/downloads/point/last-month/@sc/p@k", '{"downloads": @k}', None),
    (1, "https://rubygems.org/api/v1/gems/g@k.json", '{"version": "2", "authors": "A@k"}', None),
    (1, "https://rubygems.org/api/v1/versions/g@k.json", f'[{{"number": "2", "created_at": "{_DAY.format(2)}"}}, {{"number": "1", "created_at": "{_DAY.format(1)}"}}]', "k % 16 = 1"),
    (2, "https://plugins.jetbrains.com/api/searchPlugins?search=x.@k&max=20", '{"plugins": [{"xmlId": "x", "id": 7}, {"xmlId": "x.@k", "id": @k}]}', "k % 24 <> 2"),
    (2, "https://plugins.jetbrains.com/api/searchPlugins?search=x.@k&max=20", '{"plugins": [{"xmlId": "x.@k.other", "id": @k}]}', "k % 24 = 2"),
    (2, "https://plugins.jetbrains.com/api/plugins/@k", '{"xmlId": "x.@k", "vendor": "V@k"}', None),
    (2, "https://plugins.jetbrains.com/api/plugins/@k/updates?size=1", '[{"version": "3.@k", "cdate": "1704153600999"}]', None),
    (3, "https://azuresearch-usnc.nuget.org/query?q=packageid:n@k&prerelease=true&semVerLevel=2.0.0", '{"data": [{"id": "N@k", "version": "2.0", "versions": [{"version": "1.0-Beta"}, {"version": "2.0"}]}]}', None),
    (3, _REG + "index.json", f'{{"items": [{{"@id": "{_REG}a", "items": [{_entry("0.1", 1)}]}}, {{"@id": "{_REG}b"}}, {{"@id": "{_REG}c"}}, {{"@id": "{_REG}b"}}]}}', None),
    (3, _REG + "b", f'{{"items": [{_entry("1.0-Beta", 2, ", " + chr(34) + "listed" + chr(34) + ": false")}, {_entry("2.0", 3)}]}}', None),
    (3, "https://api.nuget.org/v3-flatcontainer/n@k/1.0-beta/n@k.nuspec", "<package><metadata><license type='expression'>MIT</license></metadata></package>", None),
    (3, "https://api.nuget.org/v3-flatcontainer/n@k/2.0/n@k.nuspec", "<package><metadata><license type='expression'>BSD</license></metadata></package>", None),
    (6, "https://crates.io/api/v1/crates/c@k", '{"crate": {"max_version": "4.@k"}}', "k % 16 = 6"),
    (6, "https://crates.io/api/v1/crates/c@k", "no document", "k % 16 <> 6"),
    (7, "https://pub.dev/api/packages/d@k", '{"latest": {"version": "5.@k"}}', None),
]
_PURLS = ["pkg:npm/%40sc/p@k", "pkg:gem/g@k@1", "pkg:jetbrains/x.@k", "pkg:nuget/N@k@1.0-Beta", "pkg:vscode/pub/e@k", "pkg:snap/s@k", "pkg:cargo/c@k", "pkg:pub/d@k"]
_SNAP = "https://api.snapcraft.io/v2/snaps/info/s@k?fields=title,summary,description,license,publisher,store-url,website,version"


def lookup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of packages of eight registries whose documents are found in two rounds, POST and headers among them."""
    keys = _table(spark, sf_dir, "part", "p_partkey").withColumnRenamed("p_partkey", "k")
    nothing = F.lit(None).cast("string")
    no_headers = F.lit(None).cast("array<struct<name:string,value:string>>")
    given = []
    for rest, url, content, where in ANSWERS:
        given.append(F.when((F.col("k") % 8 == rest) & (F.expr(where) if where else F.lit(True)), F.struct(_k(url).alias("url"), no_headers.alias("headers"), nothing.alias("body"), _k(content).alias("content"))))
    snap = lambda headers, version: F.when(F.col("k") % 8 == 5, F.struct(_k(_SNAP).alias("url"), headers.alias("headers"), nothing.alias("body"), _k(f'{{"snap": {{"title": "T@k"}}, "channel-map": [{{"version": "{version}"}}]}}').alias("content")))
    series = F.array(F.struct(F.lit("Snap-Device-Series").alias("name"), F.lit("16").alias("value")))
    given += [snap(series, "6.@k"), snap(no_headers, "none")]
    asked_for = _k('{"filters":[{"criteria":[{"filterType":7,"value":"pub.e@k"}]}],"flags":403}')
    found = _k('{"results": [{"extensions": [{"versions": [{"version": "7.@k"}]}]}]}')
    given.append(F.when(F.col("k") % 8 == 4, F.struct(F.lit(resolve.MARKET).alias("url"), no_headers.alias("headers"), asked_for.alias("body"), found.alias("content"))))
    responses = keys.select(F.explode(F.array_compact(F.array(*given))).alias("r")).select("r.*", nothing.alias("error"))
    purls = keys.select(F.element_at(F.array(*[_k(p) for p in _PURLS]), (F.col("k") % 8 + 1).cast("int")).alias("purl"))
    kinds = ("npm", "gem", "jetbrains", "nuget", "vscode", "snap", "cargo", "pub")
    records = lookups.registry_records(purls, _serve(responses), kinds=kinds)
    return records.select("purl", "ecosystem", "name", "version", "published_at", "previous_published_at", "release_count", "license", "author", "title", "downloads_recent", "version_removed")


_NULLS = {"published_at": "BIGINT", "previous_published_at": "BIGINT", "release_count": "BIGINT", "license": "VARCHAR", "author": "VARCHAR", "title": "VARCHAR", "downloads_recent": "BIGINT", "version_removed": "BOOLEAN"}


def _told(purl: str, ecosystem: str, name: str, version: str, where: str, **fields: str) -> str:
    rest = ", ".join(f"{fields.get(f, f'CAST(NULL AS {t})')} AS {f}" for f, t in _NULLS.items())
    text = lambda t: "replace('" + t + "', '@k', '' || p_partkey)"
    return f"SELECT {text(purl)} AS purl, '{ecosystem}' AS ecosystem, {text(name)} AS name, {text(version)} AS version, {rest} FROM part WHERE {where}"


_RECORDS = " UNION ALL ".join([
    _told(_PURLS[0], "npm", "@sc/p@k", "1.@k", "p_partkey % 8 = 0", downloads_recent="p_partkey", author="'a'", version_removed="false"),
    _told(_PURLS[1], "gem", "g@k", "1", "p_partkey % 8 = 1", published_at=f"CASE WHEN p_partkey % 16 = 1 THEN {DAY1} END", author="'A' || p_partkey"),
    _told(_PURLS[2], "jetbrains", "x.@k", "3.@k", "p_partkey % 8 = 2 AND p_partkey % 24 <> 2", published_at=str(DAY2), author="'V' || p_partkey"),
    _told(_PURLS[3], "nuget", "N@k", "1.0-Beta", "p_partkey % 8 = 3", published_at=str(DAY2), previous_published_at=str(DAY1), release_count="5", license="'MIT'", version_removed="true"),
    _told(_PURLS[4], "vscode", "pub.e@k", "7.@k", "p_partkey % 8 = 4"),
    _told(_PURLS[5], "snap", "s@k", "6.@k", "p_partkey % 8 = 5", title="'T' || p_partkey"),
    _told(_PURLS[6], "crates", "c@k", "4.@k", "p_partkey % 16 = 6"),
    _told(_PURLS[7], "pub", "d@k", "5.@k", "p_partkey % 8 = 7"),
])

#: kind -> (package URL, what the first and the second repository write of a key, other entries before it); ``@v`` is a version, ``~`` a line end.
INDEXES = {
    "alpine": ("pkg:apk/alpine/a@k", "C:q~P:a@k~V:@v~m:M@k <m@x.y>~L:MIT", "P:a@k-doc~V:0", "~~"),
    "ubuntu": ("pkg:deb/ubuntu/a@k", "Package: a@k~Version: @v~Maintainer: M@k <m@x.y>~Description: d~ Package: z", "Package: a@k-dev~Version: 0", "~~"),
    "opensuse": ("pkg:rpm/opensuse/a@k", '<package type="rpm"><name>a@k</name><version epoch="0" ver="@v"/><packager>M@k</packager></package>', "<package><name>xa@k</name></package>", "~"),
    "netbsd": ("pkg:netbsd/a@k", "PKGNAME=a@k-@v~MAINTAINER=M@k <m@x.y>", "PKGNAME=xa@k-0", "~~"),
    "freebsd": ("pkg:freebsd/a@k", '{"name":"a@k","version":"@v","maintainer":"M@k <m@x.y>"}', 'no entry~{"name":"a@k.x"}', "~"),
    "openbsd": ("pkg:openbsd/a@k", "-rw-r--r-- 1 root wheel 10 Jan 1 00:00 pool/a@k-@v.tgz", "-rw 1 a@k-lib-0.tgz", "~"),
}


def _indexes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(base, body): two repositories' whole indexes; a third of the keys in the first, two thirds in the second, twice each."""
    _, entry, other, between = INDEXES[kind]
    keys = _table(spark, sf_dir, "part", "p_partkey", "p_size").withColumnRenamed("p_partkey", "k")
    line = lambda v: F.replace(F.replace(_k(entry), F.lit("@v"), v), F.lit("~"), F.lit("\n"))
    gap, noise = between.replace("~", "\n"), F.replace(_k(other), F.lit("~"), F.lit("\n"))
    both = [("r0", "k % 3 = 0", "1."), ("r1", "k % 3 < 2", "2.")]
    made = None
    for base, where, version in both:
        texts = keys.where(where).select("k", F.concat_ws(gap, noise, line(F.concat(F.lit(version), "p_size")), line(F.lit("9"))).alias("text"))
        one = texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda t: t["text"]), gap).alias("body")).withColumn("base", F.lit(base))
        made = one if made is None else made.unionByName(one)
    return made


def _index_query(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bodies = _indexes(spark, sf_dir, kind)
        where = {kind: ("r0", "r1")}
        if kind == "opensuse":  # each repository's own index names the one of its packages
            named = bodies.select(F.concat("base", F.lit("/repodata/repomd.xml")).alias("url"), F.lit('<data type="other"><location href="x"/></data>\n<data type="primary"><location href="repodata/primary.xml.gz"/></data>').alias("content"), F.lit(None).cast("string").alias("error"))
            urls = lookups.index_urls(kind, _serve(named), spark, where)
            bodies = bodies.withColumn("url", F.concat("base", F.lit("/repodata/primary.xml.gz")))
        else:
            urls, bodies = lookups.index_urls(kind, spark=spark, repositories=where), bodies.withColumnRenamed("base", "url")
        indexes = bodies.select("url", "body").join(F.broadcast(urls), "url")
        lines = _table(spark, sf_dir, "lineitem", "l_partkey").withColumnRenamed("l_partkey", "k")
        asked = lookups.packages(lines.select(_k(INDEXES[kind][0]).alias("purl")))
        return lookups.index_records(asked, indexes, kind).select("purl", "ecosystem", "name", "version", "author")

    return query


def _index_oracle(kind: str) -> str:
    purl = INDEXES[kind][0].replace("@k", "")
    author = "CAST(NULL AS VARCHAR)" if kind == "openbsd" else "'M' || k"
    return f"""WITH asked AS (SELECT DISTINCT l_partkey AS k FROM lineitem) SELECT '{purl}' || k AS purl, '{kind}' AS ecosystem, 'a' || k AS name, CASE k % 3 WHEN 0 THEN '1.' ELSE '2.' END || p_size AS version, {author} AS author
FROM asked JOIN part ON p_partkey = k WHERE k % 3 < 2"""


#: Package URLs and the normalizer that serves them.
DISPATCH = {
    "pkg:npm/a@k": "npm", "pkg:deb/debian/a@k": "debian", "pkg:deb/ubuntu/a@k": "ubuntu", "pkg:deb/kali/a@k": "debian", "pkg:deb/ubuntu": "debian", "pkg:rpm/fedora/a@k": "fedora", "pkg:rpm/centos/a@k": "fedora", "pkg:rpm/opensuse/a@k": "opensuse",
    "pkg:rpm/a@k": "fedora", "pkg:apk/wolfi/a@k": "wolfi", "pkg:apk/x/a@k": "alpine", "pkg:apk/a@k": "alpine", "pkg:alpm/aur/a@k": "aur", "pkg:alpm/arch/a@k": "arch", "pkg:alpm/a@k?repository_url=https://aur.archlinux.org": "aur",
    "pkg:docker/a@k": "oci", "pkg:oci/a@k": "oci", "pkg:chrome-extension/a@k": "chrome", "pkg:vscode-extension/p/a@k": "vscode", "pkg:vscode-extension/p/a@k?repository_url=https://open-vsx.org": "openvsx", "pkg:vscode/p/a@k": "vscode",
    "PKG:NPM/a@k": "npm", "pkg:generic/a@k": None, "a@k": None,
}


def registry_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which registry serves a package URL."""
    keys = _table(spark, sf_dir, "part", "p_partkey").withColumnRenamed("p_partkey", "k")
    purls = F.array(*[_k(p) for p in DISPATCH])
    rows = keys.select("k", F.element_at(purls, (F.col("k") % len(DISPATCH) + 1).cast("int")).alias("purl"))
    p = lookups.parse("purl")
    return rows.select("k", registry.dispatch(p["type"], p["path"], F.col("purl")).alias("kind"))


def resolve_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download URLs of editor extensions: the marketplace is asked for the newest version where none is given."""
    keys = _table(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "k")
    purl = F.concat(F.when(F.col("k") % 3 == 0, "pkg:vscode-extension/").otherwise("pkg:vscode/"), _k("pub/e@k"), F.when(F.col("k") % 4 == 0, _k("@8.@k")).otherwise(""))
    posted = _k('{"filters":[{"criteria":[{"filterType":7,"value":"pub.e@k"}]}],"flags":914}')
    answer = _k('{"results": [{"extensions": [{"versions": [{"version": "9.@k"}, {"version": "1"}]}]}]}')
    documents = keys.where("k % 5 > 0").select(F.lit(resolve.MARKET).alias("url"), posted.alias("posted"), F.when(F.col("k") % 5 == 1, F.lit('{"results": []}')).otherwise(answer).alias("body"))
    refs = keys.select("k", F.lit("purl").alias("locator_type"), purl.alias("locator"))
    return resolve.resolve_with_documents(refs, documents).select("k", "resolved_url")


#: Package URLs of the open extension registry, the document each asks for, and what it answers.
_OPEN = [
    ("pkg:openvsx/ns/x@k", "https://open-vsx.org/api/ns/x@k", '{"files": {"download": "https://f/@k"}}', "https://f/@k"),
    ("pkg:openvsx/ns/x@k@1.2", "https://open-vsx.org/api/ns/x@k/1.2", '{"files": {"download": "https://f/@k-1.2"}}', "https://f/@k-1.2"),
    ("pkg:vscode-extension/ns/x@k@3?repository_url=https://open-vsx.org", "https://open-vsx.org/api/ns/x@k/3", '{"files": {"download": "https://f/@k-3"}}', "https://f/@k-3"),
    ("pkg:openvsx/ns/x@k@9", "https://open-vsx.org/api/ns/x@k/9", '{"files": {}}', None),
    ("pkg:openvsx/plain@k", "https://open-vsx.org/api/plain@k", '{"files": {"download": "https://f/none"}}', None),
]


def resolve_openvsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download URLs of extensions that their registry's document names."""
    keys = _table(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "k")
    at = lambda i: F.element_at(F.array(*[_k(o[i]) for o in _OPEN]), (F.col("k") % len(_OPEN) + 1).cast("int"))
    refs = keys.select("k", F.lit("purl").alias("locator_type"), at(0).alias("locator"))
    return resolve.resolve_with_documents(refs, keys.select(at(1).alias("url"), at(2).alias("body"))).select("k", "resolved_url")


QUERIES = {"resolve_openvsx": resolve_openvsx, "resolve_market": resolve_market, "lookup_records": lookup_records, "registry_dispatch": registry_dispatch} | {f"index_{k}": _index_query(k) for k in INDEXES}
ORACLES = {
    "resolve_openvsx": f"SELECT c_custkey AS k, CASE c_custkey % {len(_OPEN)} " + " ".join(f"WHEN {i} THEN replace('{o[3]}', '@k', '' || c_custkey)" for i, o in enumerate(_OPEN) if o[3]) + " END AS resolved_url FROM customer",
    "resolve_market": """SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 5 > 1 THEN 'https://pub.gallery.vsassets.io/_apis/public/gallery/publisher/pub/extension/e' || c_custkey || '/' || CASE WHEN c_custkey % 4 = 0 THEN '8.' ELSE '9.' END || c_custkey || '/assetbyname/Microsoft.VisualStudio.Services.VSIXPackage' END AS resolved_url FROM customer""",
    "lookup_records": _RECORDS,
    "registry_dispatch": f"SELECT p_partkey AS k, CASE p_partkey % {len(DISPATCH)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(DISPATCH.values()) if v) + " END AS kind FROM part",
} | {f"index_{k}": _index_oracle(k) for k in INDEXES}
