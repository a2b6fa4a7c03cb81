"""Resolution: locators to fetchable URLs, by templates alone or with registry documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import jstr
from ..functions.purl import coordinate, goproxy_escape, is_web_scheme, last_segment, parse, purl_qualifier, qualifier_of, purl_rest, purl_type, safe_coordinate, safe_filename_part
from ..functions.scalars import percent_decoded
from ..functions.text import col
from ..sources.stages import meet


def resolve_oci(rest: Column, decode: bool = True) -> Column:
    """``oci://`` reference of an image package URL; docker.io and library are the defaults."""
    bare = F.substring_index(rest, "?", 1)
    name, version = coordinate(bare), F.when(bare.contains("@"), F.substring_index(bare, "@", -1))
    repo = qualifier_of(rest, "repository_url")
    first = F.substring_index(name, "/", 1)
    place = F.when(~name.contains("/"), F.concat(F.lit("docker.io/library/"), name)).when(first.rlike("[.:]"), name).otherwise(F.concat(F.lit("docker.io/"), name))
    place = F.coalesce(percent_decoded(repo) if decode else repo, place)
    tag = F.coalesce(version, qualifier_of(rest, "tag"), F.lit("latest"))
    return F.when(name != "", F.concat(F.lit("oci://"), place, F.when(version.startswith("sha256:"), "@").otherwise(":"), tag))


def resolve_purl(purl, decode: bool = True) -> Column:
    """Artifact URL of a package URL by the templates of its type; null where there is none or it isn't safe.

    ``decode=False`` leaves percent escapes in qualifiers alone.
    """
    p = parse(purl)
    kind, path, version = p["type"], p["path"], p["version"]
    c = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    name = F.replace(path, F.lit("%40"), F.lit("@"))
    ident, low = F.lower(path), F.lower(version)
    group, artifact = F.substring_index(path, "/", 1), F.substr(path, F.instr(path, "/") + 1)
    part = lambda key: percent_decoded(purl_qualifier(purl, key)) if decode else purl_qualifier(purl, key)
    ending, classifier = part("type"), part("classifier")
    maven = F.when(
        path.contains("/") & (ending.isNull() | safe_filename_part(ending)) & (classifier.isNull() | safe_filename_part(classifier)),
        c("https://repo1.maven.org/maven2/", F.replace(group, F.lit("."), F.lit("/")), "/", artifact, "/", version, "/", artifact, "-", version, F.coalesce(c("-", classifier), F.lit("")), ".", F.coalesce(ending, F.lit("jar"))),
    )
    slug = F.when(path.contains("/"), artifact).otherwise(path)
    owner = F.when(path.contains("/") & (group != ""), c("&ownerHandle=", group)).otherwise("")
    url = (
        F.when(kind == "npm", c("https://registry.npmjs.org/", name, "/-/", last_segment(name), "-", version, ".tgz"))
        .when(kind == "cargo", c("https://static.crates.io/crates/", path, "/", path, "-", version, ".crate"))
        .when(kind == "github", c("https://codeload.github.com/", path, "/tar.gz/", F.coalesce(version, F.lit("HEAD"))))
        .when(kind == "golang", c("https://proxy.golang.org/", goproxy_escape(path), "/@v/", goproxy_escape(version), ".zip"))
        .when(kind == "gem", c("https://rubygems.org/downloads/", path, "-", version, ".gem"))
        .when(kind == "nuget", c("https://api.nuget.org/v3-flatcontainer/", ident, "/", low, "/", ident, ".", low, ".nupkg"))
        .when(kind == "maven", maven)
        .when(kind.isin("chrome", "chrome-extension"), c("https://clients2.google.com/service/update2/crx?response=redirect&prodversion=120&acceptformat=crx2,crx3&x=id%3D", last_segment(path), "%26installsource%3Dondemand%26uc"))
        .when(kind == "clawhub", c("https://clawhub.ai/api/v1/download?slug=", slug, owner, F.coalesce(c("&version=", version), F.lit(""))))
    )
    safe = safe_coordinate(path) & (version.isNull() | safe_coordinate(version))
    return F.when(kind.isin("oci", "docker"), resolve_oci(purl_rest(purl), decode)).when(safe, url)


def resolve(locator_type, locator, decode: bool = True) -> Column:
    """URL of any locator: web URLs stand for themselves, paths have none."""
    kind = col(locator_type)
    return F.when(kind == "url", F.when(is_web_scheme(locator), col(locator))).when(kind == "purl", resolve_purl(locator, decode))


def metadata_url(purl) -> Column:
    """The registry document that resolving a package URL needs first; null where templates do."""
    p = parse(purl)
    kind, path, version, rest = p["type"], p["path"], p["version"], purl_rest(purl)
    c = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    name, addon = F.replace(rest, F.lit("%40"), F.lit("@")), c("https://addons.mozilla.org/api/v5/addons/addon/", last_segment(path), "/")
    vsx = c("https://open-vsx.org/api/", path, F.coalesce(c("/", version), F.lit("")))
    return (
        F.when((kind == "npm") & ~rest.contains("@"), c("https://registry.npmjs.org/", name))
        .when((kind == "openvsx") | (kind == "vscode-extension") & col(purl).contains("open-vsx.org"), F.when(path.contains("/"), vsx))
        .when(kind == "firefox", F.when(last_segment(path) != "", F.when(version.isNull(), addon).otherwise(c(addon, "versions/", version, "/"))))
        .when((kind == "aur") | (kind == "alpm") & (col(purl).contains("aur.archlinux.org") | rest.startswith("aur/")), c("https://aur.archlinux.org/rpc/v5/info?arg%5B%5D=", last_segment(path)))
        .when((kind == "pypi") & version.isNotNull(), c("https://pypi.org/pypi/", path, "/", version, "/json"))
        .when((kind == "composer") & version.isNotNull(), c("https://repo.packagist.org/p2/", path, ".json"))
    )


#: Where the query of the editor marketplace goes, and what resolving asks for.
MARKET, NEWEST = "https://marketplace.visualstudio.com/_apis/public/gallery/extensionquery", 914


def market_query(publisher_name: Column, flags: int) -> Column:
    """The body of the marketplace's query for one extension, made by the JSON writer."""
    criteria = F.array(F.struct(F.lit(7).alias("filterType"), publisher_name.alias("value")))
    return F.to_json(F.struct(F.array(F.struct(criteria.alias("criteria"))).alias("filters"), F.lit(flags).alias("flags")))


def metadata_post(purl) -> Column:
    """The body to POST to ``MARKET`` for a package URL without a version; null for all that need no such query."""
    p = parse(purl)
    ours = (p["type"] == "vscode") | (p["type"] == "vscode-extension") & ~col(purl).contains("open-vsx.org")
    return F.when(ours & p["version"].isNull() & p["path"].contains("/"), market_query(F.concat_ws(".", F.substring_index(p["path"], "/", 1), F.substr(p["path"], F.instr(p["path"], "/") + 1)), NEWEST))


def pick_pypi_file(doc: Column, kind: Column) -> Column:
    """URL of the file to fetch: the most portable wheel, or a source archive first if asked for; else any."""
    files = F.from_json(F.get_json_object(doc, "$.urls"), "array<struct<url: string, filename: string, packagetype: string>>")
    rank = lambda f: F.when(f["filename"].endswith("-py3-none-any.whl"), 0).when(f["filename"].contains("-none-any."), 1).otherwise(2)
    wheels = F.array_sort(F.transform(F.filter(F.transform(files, lambda f, i: F.struct(F.coalesce(rank(f), F.lit(2)).alias("r"), i.alias("i"), f["url"].alias("url"), f["packagetype"].alias("t"))), lambda f: f["t"] == "bdist_wheel"), lambda f: f))
    wheel = F.get(wheels, F.lit(0))["url"]
    sdist = F.get(F.filter(files, lambda f: f["packagetype"] == "sdist"), F.lit(0))["url"]
    anything = F.get(files, F.lit(0))["url"]
    return F.when(kind == "sdist", F.coalesce(sdist, wheel, anything)).otherwise(F.coalesce(wheel, sdist, anything))


def resolve_with_documents(refs: DataFrame, documents: DataFrame, locator_type: str = "locator_type", locator: str = "locator") -> DataFrame:
    """Append ``resolved_locator`` and ``resolved_url``; ``documents(url, body[, posted])`` are registry answers.

    One left equi-join by URL and what was posted to it ('' for a GET), on distinct documents;
    unversioned npm and Firefox packages are refined to the release that the document names.
    """
    is_purl = F.col(locator_type) == "purl"
    post = F.when(is_purl, metadata_post(locator))
    asked = refs.withColumns({"__posted": F.coalesce(post, F.lit("")), "__doc_url": F.when(post.isNotNull(), F.lit(MARKET)).otherwise(F.when(is_purl, metadata_url(locator)))})
    posted = F.coalesce("posted", F.lit("")) if "posted" in documents.columns else F.lit("")
    found = documents.groupBy(F.col("url").alias("__doc_url"), posted.alias("__posted")).agg(F.first("body").alias("__body"))
    rows = meet(asked, found, ["__doc_url", "__posted"], "left").withColumn("__doc", F.try_parse_json("__body"))
    p = parse(locator)
    kind, path, version = p["type"], p["path"], p["version"]
    doc = F.col("__doc")
    c = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    latest = jstr(doc, "$['dist-tags'].latest")
    npm_locator = c("pkg:npm/", purl_rest(locator), "@", latest)
    tarball = F.call_function("get_json_object", F.col("__body"), c("$.versions['", latest, "'].dist.tarball"))
    firefox_version = F.when(version.isNull(), jstr(doc, "$.current_version.version")).otherwise(jstr(doc, "$.version"))
    firefox_url = F.when(version.isNull(), jstr(doc, "$.current_version.file.url")).when(firefox_version == version, jstr(doc, "$.file.url"))
    wanted = F.regexp_replace(version, "^v+", "")
    releases = F.from_json(F.call_function("get_json_object", F.col("__body"), c("$.packages['", path, "']")), "array<struct<version: string, dist: struct<url: string>>>")
    composer = F.get(F.filter(releases, lambda r: F.regexp_replace(r["version"], "^v+", "") == wanted), F.lit(0))["dist"]["url"]
    publisher, name = F.substring_index(path, "/", 1), F.substr(path, F.instr(path, "/") + 1)
    vscode = F.when(path.contains("/"), c("https://", publisher, ".gallery.vsassets.io/_apis/public/gallery/publisher/", publisher, "/extension/", name, "/", F.coalesce(version, jstr(doc, "$.results[0].extensions[0].versions[0].version")), "/assetbyname/Microsoft.VisualStudio.Services.VSIXPackage"))
    aur = F.coalesce(c("https://aur.archlinux.org", jstr(doc, "$.results[0].URLPath")), c("https://aur.archlinux.org/cgit/aur.git/snapshot/", last_segment(path), ".tar.gz"))
    url = (
        F.when(F.col("__doc_url").startswith("https://registry.npmjs.org/"), F.coalesce(tarball, resolve_purl(npm_locator)))
        .when(F.col("__doc_url").startswith("https://open-vsx.org/"), jstr(doc, "$.files.download"))
        .when(kind == "firefox", firefox_url)
        .when(F.col("__doc_url").startswith("https://aur.archlinux.org/"), aur)
        .when((kind == "pypi") & version.isNotNull(), pick_pypi_file(F.col("__body"), purl_qualifier(locator, "kind")))
        .when((kind == "composer") & version.isNotNull(), composer)
        .when(kind.isin("vscode", "vscode-extension"), vscode)
    )
    assisted = F.col("__doc_url").isNotNull() | kind.isin("vscode", "vscode-extension", "openvsx", "firefox")
    refined = F.when((kind == "npm") & F.col("__doc_url").isNotNull(), npm_locator).when((kind == "firefox") & version.isNull(), c("pkg:firefox/", path, "@", firefox_version)).otherwise(F.col(locator))
    rows = rows.withColumn("resolved_url", F.when(is_purl & F.coalesce(assisted, F.lit(False)), url).otherwise(resolve(locator_type, locator)))
    return rows.withColumn("resolved_locator", F.when(F.col("resolved_url").isNotNull(), F.when(is_purl, refined).otherwise(F.col(locator)))).drop("__doc_url", "__posted", "__body", "__doc")
