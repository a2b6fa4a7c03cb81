"""Offline routing report: what a package URL is, and which documents would be read for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.purl import goproxy_escape, identity_of, last_segment, normalize, parse, purl_qualifier, safe_coordinate
from .registry import dispatch
from .resolve import metadata_url, resolve_purl

#: The first document that each registry is asked for. ``{name}`` is the path with a plain
#: scope sign, ``{path}`` the path as written, ``{last}`` its last segment, ``{low}`` in lower case,
#: ``{go}`` escaped for the module proxy, ``{version}`` the version asked for.
ENDPOINTS = {
    "npm": "https://registry.npmjs.org/{name}",
    "cargo": "https://crates.io/api/v1/crates/{path}",
    "pypi": "https://pypi.org/pypi/{path}/json",
    "composer": "https://packagist.org/packages/{path}.json",
    "gem": "https://rubygems.org/api/v1/gems/{path}.json",
    "golang": "https://proxy.golang.org/{go}/@latest",
    "github": "https://api.github.com/repos/{path}",
    "aur": "https://aur.archlinux.org/rpc/v5/info?arg%5B%5D={last}",
    "chrome": "https://chromewebstore.google.com/detail/{last}",
    "openvsx": "https://open-vsx.org/api/{path}",
    "vscode": "https://marketplace.visualstudio.com/_apis/public/gallery/extensionquery",
    "nuget": "https://azuresearch-usnc.nuget.org/query?q=packageid:{low}&prerelease=true&semVerLevel=2.0.0",
    "hex": "https://hex.pm/api/packages/{path}",
    "cran": "https://crandb.r-pkg.org/{last}",
    "cpan": "https://fastapi.metacpan.org/v1/release/{last}",
    "pub": "https://pub.dev/api/packages/{last}",
    "conda": "https://api.anaconda.org/package/conda-forge/{last}",
    "clojars": "https://clojars.org/api/artifacts/{path}",
    "arch": "https://archlinux.org/packages/search/json/?name={last}",
    "fedora": "https://mdapi.fedoraproject.org/rawhide/pkg/{last}",
    "clawhub": "https://clawhub.ai/api/v1/skills/{last}",
    "homebrew": "https://formulae.brew.sh/api/formula/{last}.json",
    "snap": "https://api.snapcraft.io/v2/snaps/info/{last}?fields=title,summary,description,license,publisher,store-url,website,version",
    "wordpress": "https://api.wordpress.org/plugins/info/1.0/{last}.json",
    "huggingface": "https://huggingface.co/api/models/{path}",
    "firefox": "https://addons.mozilla.org/api/v5/addons/addon/{last}/",
    "jetbrains": "https://plugins.jetbrains.com/api/searchPlugins?search={last}&max=20",
    "alpine": "https://dl-cdn.alpinelinux.org/alpine/latest-stable/main/x86_64/APKINDEX.tar.gz",
    "wolfi": "https://packages.wolfi.dev/os/x86_64/APKINDEX.tar.gz",
    "debian": "https://deb.debian.org/debian/dists/stable/main/binary-amd64/Packages.gz",
    "ubuntu": "https://archive.ubuntu.com/ubuntu/dists/noble/main/binary-amd64/Packages.gz",
    "opensuse": "https://download.opensuse.org/tumbleweed/repo/oss/repodata/repomd.xml",
    "rpmfusion": "https://download1.rpmfusion.org/free/fedora/development/rawhide/Everything/x86_64/os/repodata/repomd.xml",
    "netbsd": "https://cdn.netbsd.org/pub/pkgsrc/packages/NetBSD/x86_64/10.0/All/pkg_summary.gz",
    "freebsd": "https://pkg.freebsd.org/FreeBSD:14:amd64/latest/packagesite.pkg",
    "openbsd": "https://cdn.openbsd.org/pub/OpenBSD/snapshots/packages/amd64/index.txt",
}
#: Where the hosts of images tell about a repository; others don't.
IMAGE_HOSTS = {"docker.io": "https://hub.docker.com/v2/repositories/", "quay.io": "https://quay.io/api/v1/repository/"}
#: What is asked for instead when a version is given.
VERSIONED = {"golang": "https://proxy.golang.org/{go}/@v/{gov}.info", "openvsx": "https://open-vsx.org/api/{path}/{version}"}


def registry_url(purl) -> Column:
    """URL of the first registry document of a package URL; null if its type has no registry or it isn't safe."""
    p = parse(purl)
    kind, path, version = p["type"], p["path"], p["version"]
    values = {"name": F.replace(path, F.lit("%40"), F.lit("@")), "path": path, "last": last_segment(path), "low": F.lower(path), "go": goproxy_escape(path), "gov": goproxy_escape(version), "version": version}

    def fill(template: str) -> Column:
        out, parts = [], template.split("{")
        out.append(F.lit(parts[0]))
        for part in parts[1:]:
            key, rest = part.split("}", 1)
            out += [values[key], F.lit(rest)]
        return F.concat(*out)

    served = dispatch(kind, path, purl if isinstance(purl, Column) else F.col(purl))
    named = F.nullif(purl_qualifier(purl, "repository_url"), F.lit(""))
    repository = F.coalesce(F.try_url_decode(F.replace(named, F.lit("+"), F.lit("%2B"))), F.concat(F.lit("docker.io/library/"), last_segment(path)))
    host, rest = F.substring_index(repository, "/", 1), F.regexp_extract(repository, "^[^/]*/(.*)$", 1)
    hub = F.create_map(*[F.lit(x) for kv in IMAGE_HOSTS.items() for x in kv])
    image = F.when(repository.contains("/"), F.concat(hub[host], rest))
    scoped = r"^(?:%40|@)([^/]+)/(.+)$"
    jsr = F.when(path.rlike(scoped), F.regexp_replace(path, F.lit(scoped), F.lit("https://api.jsr.io/scopes/$1/packages/$2")))
    group, artifact = F.substring_index(path, "/", 1), last_segment(path)
    maven = F.concat(F.lit("https://search.maven.org/solrsearch/select?q=g:%22"), group, F.lit("%22+AND+a:%22"), artifact, F.lit("%22"), F.coalesce(F.concat(F.lit("+AND+v:%22"), version, F.lit("%22")), F.lit("")), F.lit("&core=gav&rows=20&wt=json"))
    url = F.when(served == "oci", image).when(served == "jsr", jsr).when(served == "maven", maven)
    for name, template in VERSIONED.items():
        url = url.when((served == name) & version.isNotNull(), fill(template))
    for name, template in ENDPOINTS.items():
        url = url.when(served == name, fill(template))
    return F.when(safe_coordinate(path) & (version.isNull() | safe_coordinate(version)), url)


def probe(purls: DataFrame, purl: str = "purl") -> DataFrame:
    """One report row an input row, also for what can't be parsed: its parts, canonical forms and URLs."""
    p = parse(purl)
    rows = normalize(purls, purl, "normalized").withColumns({"type": p["type"], "path": F.coalesce(p["path"], F.lit("")), "version": p["version"], "identity": identity_of("normalized")})
    return rows.withColumns({"registry_url": registry_url(purl), "metadata_url": metadata_url(purl), "download_url": resolve_purl(purl, decode=False)})


def paged(items: DataFrame, pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Entries of an index whose pages hold them inline or by reference; missing pages are passed over.

    ``items(key, pos, page_id, inline array)`` meets ``pages(page_id, fetched array)`` in one left join.
    """
    rows = items.join(pages, page_id, "left").withColumn("entries", F.coalesce("inline", "fetched"))
    return rows.select("key", "pos", F.posexplode("entries").alias("sub", "entry"))
