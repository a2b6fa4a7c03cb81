"""Registry records of package URLs: documents followed round by round, and indexes searched by name.

Most registries answer for one package. Where a document only leads to others (a search to the plugin,
a registration to its pages, a search answer to the manifest of its version) the next round's requests
are made from the round before. All packages of all registries go through a round together, and each
request is served once, whoever asks. Distributions publish one index of all packages: its entries are
joined to the asked names in one pass, and no index is copied to the packages that ask for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import jparts, jstr, ju64
from ..functions.purl import last_segment, parse
from ..functions.scalars import primary_href, stanza_field, tag_text
from ..functions.text import BLANK
from ..sources.stages import cut, meet
from . import registry
from .probe import registry_url
from .resolve import MARKET, market_query

_REQUEST = "array<struct<slot:string,url:string,headers:array<struct<name:string,value:string>>,body:string>>"

#: The repositories of each distribution, in the order they are searched.
REPOSITORIES = {
    "alpine": ("https://dl-cdn.alpinelinux.org/alpine/latest-stable/main/x86_64/APKINDEX.tar.gz", "https://dl-cdn.alpinelinux.org/alpine/latest-stable/community/x86_64/APKINDEX.tar.gz"),
    "wolfi": ("https://packages.wolfi.dev/os/x86_64/APKINDEX.tar.gz",),
    "debian": ("https://deb.debian.org/debian/dists/stable/main/binary-amd64/Packages.gz",),
    "ubuntu": ("https://archive.ubuntu.com/ubuntu/dists/noble/main/binary-amd64/Packages.gz", "https://archive.ubuntu.com/ubuntu/dists/noble/universe/binary-amd64/Packages.gz"),
    "opensuse": ("https://download.opensuse.org/tumbleweed/repo/oss",),
    "rpmfusion": ("https://download1.rpmfusion.org/free/fedora/development/rawhide/Everything/x86_64/os",),
    "netbsd": ("https://cdn.netbsd.org/pub/pkgsrc/packages/NetBSD/x86_64/10.0/All/pkg_summary.gz",),
    "freebsd": ("https://pkg.freebsd.org/FreeBSD:14:amd64/latest/packagesite.pkg",),
    "openbsd": ("https://cdn.openbsd.org/pub/OpenBSD/snapshots/packages/amd64/index.txt",),
}
#: Registries that are asked by the last segment of the path.
BY_LAST = ("cran", "cpan", "pub", "conda", "arch", "fedora", "aur", "chrome", "clawhub", "homebrew", "snap", "wordpress", "firefox", "jetbrains", *REPOSITORIES)
#: What a record needs of the editor marketplace, and the headers of its queries.
MARKET_FLAGS, MARKET_HEADERS = 403, {"Content-Type": "application/json", "Accept": "application/json;api-version=3.0-preview.1"}
SNAP_HEADERS = {"Snap-Device-Series": "16"}
REGISTRATION = "https://api.nuget.org/v3/registration5-gz-semver2/"
FLAT = "https://api.nuget.org/v3-flatcontainer/"
PLUGINS = "https://plugins.jetbrains.com/api/plugins/"


def _c(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def request(slot: str | Column, url: Column, headers: dict[str, str] | None = None, body: Column | None = None) -> Column:
    """One request for the document named ``slot``."""
    held = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in headers.items()]) if headers else F.lit(None).cast("array<struct<name:string,value:string>>")
    return F.struct((F.lit(slot) if isinstance(slot, str) else slot).alias("slot"), url.alias("url"), held.alias("headers"), (F.lit(None).cast("string") if body is None else body).alias("body"))


def packages(purls: DataFrame, purl: str = "purl") -> DataFrame:
    """(purl, kind, name, version, url) of distinct package URLs that some registry serves; ``url`` is the first document's."""
    p = parse("purl")
    kind = registry.dispatch(p["type"], p["path"], F.col("purl"))
    name = F.when(F.col("kind").isin(*BY_LAST), last_segment("path")).otherwise(F.col("path"))
    rows = purls.select(F.col(purl).alias("purl")).distinct().select("purl", F.explode(F.array(F.struct(kind.alias("kind"), p["path"].alias("path"), p["version"].alias("version")))).alias("p")).select("purl", "p.*")  # evaluated once
    return rows.where("kind IS NOT NULL").select("purl", "kind", name.alias("name"), "version", registry_url("purl").alias("url"))


def _first_round(docs: Column) -> Column:
    kind, name, low = F.col("kind"), F.col("name"), F.lower("name")
    one = F.col("url")
    plain = F.replace(name, F.lit("%40"), F.lit("@"))
    addon = _c("https://addons.mozilla.org/api/v5/addons/addon/", name)
    numeric = name.rlike(r"^[0-9]+\z")
    two = lambda url: F.array(request("body", one), request("body2", url))
    return (
        F.when(kind == "npm", two(_c("https://api.npmjs.org/downloads/point/last-month/", plain)))
        .when(kind == "gem", two(_c("https://rubygems.org/api/v1/versions/", name, ".json")))
        .when(kind == "jsr", two(_c(one, "/versions")))
        .when(kind == "firefox", two(_c(addon, "/versions/?page_size=50")))
        .when(kind == "nuget", two(_c(REGISTRATION, low, "/index.json")))
        .when(kind == "jetbrains", F.when(~numeric, F.array(request("search", one))).otherwise(_plugin(name)))
        .when(kind == "vscode", F.array(request("body", F.lit(MARKET), MARKET_HEADERS, market_query(F.replace(name, F.lit("/"), F.lit(".")), MARKET_FLAGS))))
        .when(kind == "snap", F.array(request("body", one, SNAP_HEADERS)))
        .when(~kind.isin(*REPOSITORIES), F.array(request("body", one)))
    )


def _plugin(number: Column) -> Column:
    return F.array(request("body", _c(PLUGINS, number)), request("body2", _c(PLUGINS, number, "/updates?size=1")))


def _second_round(docs: Column) -> Column:
    kind, low = F.col("kind"), F.lower("name")
    answer = lambda slot: F.try_parse_json(docs[slot])
    hits = jparts(answer("search"), "$.plugins")
    number = ju64(F.get(F.filter(hits, lambda p: jstr(p, "$.xmlId") == F.col("name")), F.lit(0)), "$.id").cast("string")
    found = answer("body")
    version = F.coalesce(F.get(F.filter(F.transform(jparts(found, "$.data[0].versions"), lambda v: jstr(v, "$.version")), lambda v: v == F.col("version")), F.lit(0)), jstr(found, "$.data[0].version"), F.lit(""))
    manifest = request("body3", _c(FLAT, low, "/", F.lower(version), "/", low, ".nuspec"))
    named = F.transform(jparts(answer("body2"), "$.items"), lambda p: F.when(jparts(p, "$.items").isNull(), jstr(p, "$['@id']")))
    pages = F.transform(F.filter(named, lambda u: u.isNotNull()), lambda u: request(_c("page:", u), u))
    known = F.try_variant_get(found, "$.data[0]", "variant").isNotNull()
    return F.when((kind == "jetbrains") & number.isNotNull(), _plugin(number)).when((kind == "nuget") & known, F.concat(F.array(manifest), F.coalesce(pages, F.array().cast(_REQUEST))))


ROUNDS = (_first_round, _second_round)


def follow(asked: DataFrame, serve: Callable[[DataFrame], DataFrame], rounds=ROUNDS) -> DataFrame:
    """``asked(purl, kind, name, version, url)`` with ``docs``: a map of the documents that the rounds read.

    A round gives each row an array of requests from its columns and ``docs``. ``serve`` gets the distinct
    ``requests(url, headers, body)`` of a round and returns ``(key, content)`` for those it has, ``key``
    being ``fetching.request_key``. Rows and requests meet by key in one join a round; between rounds the
    rows are cut to a table.
    """
    from .fetching import request_key

    state = asked.withColumn("docs", F.create_map().cast("map<string,string>"))
    for number, wanted in enumerate(rounds):
        state = cut(state)
        made = state.select("purl", F.explode(wanted(F.col("docs")).cast(_REQUEST)).alias("r")).where("r.url IS NOT NULL").select("purl", "r.*")
        wants = made.withColumn("key", request_key(made))
        served = serve(wants.groupBy("key").agg(*[F.first(c).alias(c) for c in ("url", "headers", "body")]).drop("key"))
        got = meet(wants.select("purl", "slot", "key"), served.select("key", F.col("content").cast("string").alias("content")).where("content IS NOT NULL"), "key")
        whole = got.groupBy("purl").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("slot", "content")))).alias("__new"))
        state = meet(state, whole, "purl", "left").withColumn("docs", F.map_concat("docs", F.coalesce("__new", F.create_map().cast("map<string,string>")))).drop("__new")
    return state


def bodies(state: DataFrame) -> DataFrame:
    """``follow``'s rows with ``body``, ``body2`` and ``body3``; pages that a registration only names are put in their places."""
    docs = F.col("docs")
    index = jparts(F.try_parse_json(docs["body2"]), "$.items")
    items = lambda d: F.to_json(F.try_variant_get(d, "$.items", "variant"))
    page = lambda p: F.when(jparts(p, "$.items").isNotNull(), items(p)).otherwise(F.coalesce(items(F.try_parse_json(docs[_c("page:", jstr(p, "$['@id']"))])), F.lit("[]")))
    whole = _c('{"items":[', F.array_join(F.transform(index, lambda p: _c('{"items":', page(p), "}")), ","), "]}")
    second = F.when((F.col("kind") == "nuget") & index.isNotNull(), whole).otherwise(docs["body2"])
    return state.select("purl", "kind", "name", "version", docs["body"].alias("body"), second.alias("body2"), docs["body3"].alias("body3"))


def _stanzas(body) -> Column:
    return F.filter(F.split(body, r"\r?\n(?:\r?\n)+"), lambda t: t != "")


def _prefixes(stem: Column, digit: bool) -> Column:
    """What a package can be called whose archive is ``stem``: all that ends before a hyphen (and a digit after it)."""
    parts = F.split(stem, "-")
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "-").alias("name"), F.get(parts, n).alias("rest")))
    return F.transform(F.filter(cuts, lambda c: c["rest"].isNotNull() & (c["rest"].rlike("^[0-9]") if digit else F.lit(True))), lambda c: c["name"])


def index_entries(indexes: DataFrame, kind: str) -> DataFrame:
    """(url, pos, name, body) for each package that ``indexes(url, body)`` list, in order; names that fit several ways come several times."""
    return _named(indexes.select("url", F.posexplode(_parts(F.col("body"), kind)).alias("pos", "body")), kind)


def _parts(body: Column, kind: str) -> Column:
    """The entries of an index, or of a piece of one, in order."""
    if kind in ("alpine", "wolfi", "debian", "ubuntu", "netbsd"):
        return _stanzas(body)
    if kind in ("opensuse", "rpmfusion"):
        return F.regexp_extract_all(body, F.lit("(?s)(<package.*?</package>)"), 1)
    if kind == "freebsd":
        return F.split(body, "\r?\n")
    return F.filter(F.split(body, f"[{BLANK}]+"), lambda t: F.endswith(t, F.lit(".tgz")))


#: What parts the pieces that index files are read in; each holds whole entries.
SEPARATORS = {"opensuse": "</package>", "rpmfusion": "</package>", "freebsd": "\n", "openbsd": "\n"}


def index_file_entries(files: DataFrame, paths: dict[str, str], kind: str) -> DataFrame:
    """The same from files: ``paths`` names the file of each URL of ``files(url, rank)``.

    A file is read in pieces by Spark's text source (compressed ones by its codecs), so no index is held
    in one row; ``pos`` sorts as the entries stand in the file. Stanzas end at an empty line without a
    carriage return.
    """
    spark, end = files.sparkSession, SEPARATORS.get(kind, "\n\n")
    out = None
    for url, path in paths.items():
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
        pieces = spark.read.option("lineSep", end).text(path).select(F.lit(url).alias("url"), place.alias("at"), (F.concat("value", F.lit(end)) if end.startswith("<") else F.col("value")).alias("piece"))
        one = pieces.select("url", "at", F.posexplode(_parts(F.col("piece"), kind)).alias("sub", "body")).select("url", F.struct("at", "sub").alias("pos"), "body")
        out = one if out is None else out.unionByName(one)
    return _named(out, kind)


def _named(rows: DataFrame, kind: str) -> DataFrame:
    if kind in ("netbsd", "openbsd"):
        stem = stanza_field("body", "PKGNAME=") if kind == "netbsd" else F.regexp_replace(F.substring_index("body", "/", -1), r"\.tgz\z", "")
        return rows.select("url", "pos", F.explode(_prefixes(stem, kind == "openbsd")).alias("name"), "body")
    name = {"alpine": stanza_field("body", "P:"), "wolfi": stanza_field("body", "P:"), "freebsd": jstr(F.try_parse_json("body"), "$.name"), "opensuse": tag_text("body", "name"), "rpmfusion": tag_text("body", "name")}
    return rows.select("url", "pos", name.get(kind, stanza_field("body", "Package:")).alias("name"), "body").where("name IS NOT NULL")


def index_urls(kind: str, serve: Callable[[DataFrame], DataFrame] | None = None, spark=None, repositories: dict[str, tuple] = REPOSITORIES) -> DataFrame:
    """(url, rank) of a distribution's indexes; those that a repository's own index names are read from it."""
    bases = spark.createDataFrame([(u, i) for i, u in enumerate(repositories[kind])], "base string, rank int")
    if kind not in ("opensuse", "rpmfusion"):
        return bases.withColumnRenamed("base", "url")
    at = bases.withColumn("url", F.concat("base", F.lit("/repodata/repomd.xml")))
    from .fetching import metadata_key

    told = serve(at.select("url")).select("key", F.col("content").cast("string").alias("content"))
    named = at.withColumn("key", metadata_key("url")).join(told, "key").select(F.concat("base", F.lit("/"), primary_href("content")).alias("url"), "rank")
    return named.where("url IS NOT NULL")


def index_lookup(asked: DataFrame, indexes: DataFrame, kind: str, entries: DataFrame | None = None) -> DataFrame:
    """(name, url, body): for each distinct ``asked(name)`` its first entry in the first of ``indexes(url, rank, body)`` that has one.

    Entries of all indexes are made in one pass (or given, as by :func:`index_file_entries`) and meet the
    distinct names in one join; what is left of a name is reduced before the shuffle. Names that no
    index has drop out.
    """
    names = asked.select("name").where("name IS NOT NULL").distinct()
    entries = index_entries(indexes, kind) if entries is None else entries
    found = meet(entries.join(F.broadcast(indexes.select("url", "rank")), "url"), names, "name")
    return found.groupBy("name").agg(F.min_by(F.struct("url", "body"), F.struct("rank", "pos")).alias("first")).select("name", "first.url", "first.body")


def index_records(asked: DataFrame, indexes: DataFrame, kind: str, entries: DataFrame | None = None) -> DataFrame:
    """Records of ``asked(purl, name)`` from a distribution's indexes, under ``purl``."""
    found = index_lookup(asked, indexes, kind, entries).drop("url")
    docs = meet(asked.select("purl", "name"), found, "name").withColumn("version", F.lit(None).cast("string"))
    return registry.normalize(docs, kind, ("purl",))


def registry_records(purls: DataFrame, serve: Callable[[DataFrame], DataFrame], indexes: dict[str, DataFrame] | None = None, kinds: tuple[str, ...] | None = None, purl: str = "purl") -> DataFrame:
    """The record of every distinct package URL that has one, under ``purl``.

    Documents come through ``serve`` (see :func:`follow`), indexes as unpacked texts by distribution
    (see :func:`index_lookup`). ``kinds`` names the registries to look in, all by default.
    """
    asked = packages(purls, purl)
    chosen = kinds or tuple(registry.NORMALIZERS)
    whole = cut(bodies(follow(asked.where(F.col("kind").isin(*[k for k in chosen if k not in REPOSITORIES])), serve)))
    out = [registry.normalize(whole.where(F.col("kind") == k), k, ("purl",)) for k in chosen if k not in REPOSITORIES]
    out += [index_records(asked.where(F.col("kind") == k), indexes[k], k) for k in chosen if k in REPOSITORIES and indexes and k in indexes]
    records = out[0]
    for more in out[1:]:
        records = records.unionByName(more)
    return records
