"""One query for each registry normalizer: documents made from ``part`` keys, and the whole record expected of them.

A normalizer meets several documents: a full one with and without a version asked for, and odd ones with
missing parts, explicit nulls, empty texts, other types and other packages' data. The key says which one a
row holds. ``@k`` stands for the key and ``~`` for a line end. The oracle states every field of the
record but ``release_times``; what a case doesn't name is null.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry
from ..sources import readers

_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN", "float": "FLOAT"}
FIELDS = [f for f in registry.FIELDS if f != "release_times"]
#: The path asked for where a case names none.
PATH = "group/n@k"


def secs(stamp: str) -> int:
    return int(datetime.fromisoformat(stamp.replace("Z", "+00:00")).timestamp())


def _text(body) -> str | None:
    return body if body is None else body.replace("~", "\n") if isinstance(body, str) else json.dumps(body)


def _given(documents: list, place: int):
    """The column that holds each document's part at ``place`` of (path, version, bodies...)."""
    key, out = F.col("p_partkey"), F.lit(None).cast("string")
    for i, (path, version, bodies, _) in enumerate(documents):
        value = [path, version, *map(_text, bodies), None, None][place]
        if value is not None:
            out = F.when(key % len(documents) == i, F.replace(F.lit(value), F.lit("@k"), key.cast("string"))).otherwise(out)
    return out


def _expected(field: str, value) -> str:
    kind = _TYPES[registry.FIELDS[field]]
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, str):
        quoted = value.replace("'", "''")
        return f"CAST(replace('{quoted}', '@k', '' || k) AS {kind})"
    return f"CAST({str(value).lower()} AS {kind})"


_D1, _D2, _D3 = "2024-01-01T00:00:00Z", "2024-02-02T03:04:05Z", "2024-03-03T00:00:00.25Z"
_S1, _S2, _S3 = secs(_D1), secs(_D2), secs("2024-03-03T00:00:00Z")

#: kind -> (a version to ask for, bodies, record[, path]); a pair of values is that without and with the version.
CASES: dict[str, tuple] = {
    "pypi": ("1.0", [{
        "info": {"version": "2.0", "author": "", "maintainer": "M @k", "summary": "about @k", "home_page": "", "license": "MIT", "author_email": "A <a@Mail.Example>"},
        "releases": {"1.0": [{"upload_time_iso_8601": _D1, "yanked": True, "yanked_reason": "bad"}], "2.0": [{"upload_time_iso_8601": _D3}, {"upload_time_iso_8601": _D2, "yanked": False}]},
        "vulnerabilities": [{}, {}], "ownership": {"roles": [{"role": "Maintainer", "user": "m"}, {"role": "Owner", "user": "o@k"}]}}],
        {"ecosystem": "pypi", "name": "group/n@k", "version": ("2.0", "1.0"), "published_at": (_S2, _S1), "first_published_at": _S1, "previous_published_at": (_S1, None), "release_count": 2, "latest_version": "2.0", "author": "M @k", "publisher": "o@k",
         "publisher_email_domain": "mail.example", "description": "about @k", "license": "MIT", "deprecated": (None, "bad"), "vulnerability_count": 2}),
    "composer": ("1.0", [{"package": {"description": "d@k", "repository": "https://g/@k", "downloads": {"total": 9, "monthly": 3}, "favers": 4, "maintainers": [{}, {}], "versions": {
        "dev-main": {"version": "dev-main"}, "v2.0": {"version": "v2.0", "time": _D2, "license": ["BSD"], "authors": []}, "v1.0": {"version": "v1.0", "time": _D1, "license": ["MIT", "X"], "authors": [{"name": "A@k"}]}, "x-dev": {"version": "x"}}}}],
        {"ecosystem": "composer", "name": "group/n@k", "version": "v1.0", "published_at": _S1, "author": "A@k", "description": "d@k", "repository": "https://g/@k", "license": "MIT", "downloads_total": 9, "downloads_recent": 3, "rating_count": 4, "maintainers": 2}),
    "gem": ("0.9", [{"version": "1.1", "authors": "A, B", "info": "i@k", "homepage_uri": "https://h", "source_code_uri": "https://s/@k", "licenses": ["MIT", "X"], "downloads": 12, "version_downloads": 2}, [{"number": "1.1", "created_at": _D2}, {"number": "0.9", "created_at": _D1}]],
        {"ecosystem": "gem", "name": "group/n@k", "version": ("1.1", "0.9"), "published_at": (_S2, _S1), "author": "A, B", "description": "i@k", "homepage": "https://h", "repository": "https://s/@k", "license": "MIT", "downloads_total": 12, "downloads_recent": 2}),
    "golang": (None, [{"Version": "v1.@k", "Time": _D2, "Origin": {"URL": "https://g/@k"}}], {"ecosystem": "golang", "name": "group/n@k", "version": "v1.@k", "published_at": _S2, "repository": "https://g/@k"}),
    "github": (None, [{"full_name": "o/r@k", "pushed_at": _D2, "owner": {"login": "o"}, "description": "d@k", "homepage": "", "html_url": "https://github.com/o/r", "license": {"spdx_id": "NOASSERTION"}, "stargazers_count": 7, "archived": True}],
        {"ecosystem": "github", "name": "group/n@k", "version": "", "published_at": _S2, "author": "o", "title": "o/r@k", "description": "d@k", "repository": "https://github.com/o/r", "rating_count": 7, "deprecated": "archived"}),
    "aur": (None, [{"results": [{"Name": "n@k", "Version": "1-2", "LastModified": 1700000000, "FirstSubmitted": 1600000000, "Maintainer": "m@k", "CoMaintainers": ["a", "b"], "Description": "d", "URL": "https://u", "Popularity": 0.5, "NumVotes": 3, "OutOfDate": 1}]}],
        {"ecosystem": "aur", "name": "n@k", "version": "1-2", "published_at": 1700000000, "first_published_at": 1600000000, "maintainers": 3, "author": "m@k", "publisher": "m@k", "title": "n@k", "description": "d", "homepage": "https://u", "rating": 0.5, "rating_count": 3, "deprecated": "flagged out-of-date"}),
    "chrome": (None, ['<meta property="og:title" content="T@k - Chrome Web Store"><meta property="og:description" content="D@k"><div>Offered by</div><b>Dev @k</b><i>Updated</i><i>March 3, 2024</i>1,234 users 4.5 out of 5 stars 56 ratings'],
        {"ecosystem": "chrome", "name": "n@k", "version": "", "published_at": _S3, "author": "Dev @k", "title": "T@k", "description": "D@k", "homepage": "https://chromewebstore.google.com/detail/n@k", "downloads_total": 1234, "rating": 4.5, "rating_count": 56}),
    "openvsx": (None, [{"namespace": "ns", "name": "x@k", "version": "1.0", "timestamp": _D3, "publishedBy": {"loginName": "p@k"}, "allVersions": {"latest": "u", "1.0": "u"}, "namespaceAccess": "restricted", "displayName": "X", "description": "d", "homepage": "https://h", "repository": "https://r", "license": "MIT", "downloadCount": 8, "averageRating": 4, "reviewCount": 2, "deprecated": False}],
        {"ecosystem": "openvsx", "name": "group.n@k", "version": "1.0", "published_at": _S3, "author": "p@k", "publisher": "p@k", "release_count": 2, "publisher_verified": True, "title": "X", "description": "d", "homepage": "https://h", "repository": "https://r", "license": "MIT", "downloads_total": 8, "rating": 4, "rating_count": 2}),
    "vscode": (None, [{"results": [{"extensions": [{"displayName": "X@k", "shortDescription": "d", "publishedDate": _D1, "lastUpdated": _D2, "publisher": {"displayName": "P", "publisherName": "p@k", "isDomainVerified": False},
        "versions": [{"version": "2.0", "lastUpdated": _D2}, {"version": "1.0", "lastUpdated": _D1}], "statistics": [{"statisticName": "install", "value": 10.0}, {"statisticName": "averagerating", "value": 4.5}, {"statisticName": "ratingcount", "value": 6.0}]}]}]}],
        {"ecosystem": "vscode", "name": "group.n@k", "version": "2.0", "published_at": _S2, "first_published_at": _S1, "previous_published_at": _S1, "release_count": 2, "author": "P", "publisher": "p@k", "publisher_verified": False, "title": "X@k", "description": "d", "downloads_total": 10, "rating": 4.5, "rating_count": 6}),
    "nuget": ("1.0-Beta", [{"data": [{"id": "Pkg.@k", "version": "2.0", "versions": [{"version": "1.0-Beta"}, {"version": "2.0"}], "authors": ["A@k"], "owners": ["x", "y"], "description": "d", "projectUrl": "", "totalDownloads": 11, "vulnerabilities": []}]},
        {"items": [{"items": [{"catalogEntry": {"version": "1.0-Beta", "published": _D1, "listed": False, "licenseExpression": "MIT", "deprecation": {"reasons": ["Legacy"]}}}, {"catalogEntry": {"version": "2.0", "published": _D2, "listed": True, "licenseExpression": "MIT"}}]}]},
        '<package><metadata><license type="file">L.txt</license><repository type="git" url="https://g/@k" commit="c@k" /></metadata></package>'],
        {"ecosystem": "nuget", "name": "Pkg.@k", "version": ("2.0", "1.0-Beta"), "latest_version": "2.0", "published_at": (_S2, _S1), "first_published_at": _S1, "previous_published_at": (_S1, None), "release_count": 2, "author": "A@k", "description": "d", "downloads_total": 11, "maintainers": 2,
         "vulnerability_count": 0, "version_removed": (False, True), "license": "MIT", "deprecated": (None, "deprecated"), "repository": "https://g/@k", "repository_commit": "c@k"}),
    "maven": (None, [{"response": {"docs": [{"v": "3.@k", "timestamp": 1700000000999}]}}], {"ecosystem": "maven", "name": "group:n@k", "version": "3.@k", "published_at": 1700000000, "latest_version": "3.@k"}),
    "hex": ("0.1", [{"latest_stable_version": "1.0", "latest_version": "1.1-rc", "releases": [{"version": "1.0", "inserted_at": _D2}, {"version": "0.1", "inserted_at": _D1}], "meta": {"description": "d@k", "licenses": ["MIT"], "links": {"Docs": "https://docs", "GitHub": "https://g/@k"}}, "downloads": {"all": 5, "recent": 1}}],
        {"ecosystem": "hex", "name": "group/n@k", "version": ("1.0", "0.1"), "published_at": (_S2, _S1), "latest_version": "1.0", "description": "d@k", "license": "MIT", "repository": "https://g/@k", "downloads_total": 5, "downloads_recent": 1}),
    "cran": (None, [{"Package": "P@k", "Version": "1.2", "Date/Publication": "2024-02-02 03:04:05 UTC", "Maintainer": "M @k <m@x.y>", "Title": "T", "URL": "https://a, https://b", "License": "GPL"}],
        {"ecosystem": "cran", "name": "P@k", "version": "1.2", "published_at": _S2, "author": "M @k", "description": "T", "homepage": "https://a, https://b", "license": "GPL"}),
    "cpan": (None, [{"distribution": "D-@k", "version": "0.1", "date": "2024-02-02T03:04:05", "author": "AU@k", "abstract": "a", "resources": {"homepage": "https://h", "repository": {"url": "https://r"}}, "license": ["perl_5"], "status": "backpan"}],
        {"ecosystem": "cpan", "name": "D-@k", "version": "0.1", "published_at": _S2, "author": "AU@k", "description": "a", "homepage": "https://h", "repository": "https://r", "license": "perl_5", "deprecated": "removed from CPAN"}),
    "pub": ("0.9", [{"latest": {"version": "1.0", "published": _D2, "pubspec": {"description": "new", "homepage": "https://n"}}, "versions": [{"version": "0.9", "published": _D1, "pubspec": {"description": "old @k", "repository": "https://r/@k"}}, {"version": "1.0", "published": _D2, "pubspec": {"description": "new", "homepage": "https://n"}}]}],
        {"ecosystem": "pub", "name": "group/n@k", "version": ("1.0", "0.9"), "published_at": (_S2, _S1), "latest_version": "1.0", "description": ("new", "old @k"), "homepage": ("https://n", None), "repository": (None, "https://r/@k")}),
    "conda": ("1.0", [{"latest_version": "2.0", "created_at": "2023-01-01 00:00:00.000000+00:00", "summary": "s@k", "home": "https://h", "dev_url": "https://dev", "license": "BSD", "ndownloads": 6, "files": [{"version": "1.0", "upload_time": "2024-02-02 03:04:05.000000+00:00"}, {"version": "1.0", "upload_time": "2024-01-01 00:00:00.000000+00:00"}]}],
        {"ecosystem": "conda", "name": "group/n@k", "version": ("2.0", "1.0"), "published_at": (secs("2023-01-01T00:00:00Z"), _S1), "latest_version": "2.0", "description": "s@k", "homepage": "https://h", "repository": "https://dev", "license": "BSD", "downloads_total": 6}),
    "clojars": (None, [{"group_name": "g@k", "jar_name": "g@k", "latest_release": "1.0", "latest_version": "1.1-SNAPSHOT", "description": "d", "homepage": "https://h", "scm": {"url": "https://s"}, "licenses": [{"name": "EPL"}], "downloads": 4}],
        {"ecosystem": "clojars", "name": "g@k", "version": "1.0", "latest_version": "1.1-SNAPSHOT", "description": "d", "homepage": "https://h", "repository": "https://s", "license": "EPL", "downloads_total": 4}),
    "jsr": ("0.1", [{"latestVersion": "1.0", "description": "d@k", "githubRepository": {"owner": "o", "name": "r@k"}, "score": 90}, [{"version": "1.0", "createdAt": _D2}, {"version": "0.1", "createdAt": _D1}]],
        {"ecosystem": "jsr", "name": "@group/n@k", "version": ("1.0", "0.1"), "published_at": (_S2, _S1), "latest_version": "1.0", "description": "d@k", "repository": "https://github.com/o/r@k", "rating": 90}),
    "arch": (None, [{"results": [{"pkgname": "n@k", "pkgver": "1.0", "pkgrel": "2", "last_update": _D2, "build_date": _D1, "packager": "p", "pkgdesc": "d", "url": "https://u", "licenses": ["GPL"], "maintainers": ["m"], "flag_date": _D1}]}],
        {"ecosystem": "arch", "name": "n@k", "version": "1.0-2", "published_at": _S2, "author": "p", "description": "d", "homepage": "https://u", "license": "GPL", "maintainers": 1, "deprecated": "flagged out-of-date"}),
    "fedora": (None, [{"basename": "n@k", "version": "1", "release": "2.fc", "description": "long", "summary": "s", "url": "https://u", "license": "MIT"}], {"ecosystem": "fedora", "name": "n@k", "version": "1-2.fc", "description": "s", "homepage": "https://u", "license": "MIT"}),
    "clawhub": (None, [{"skill": {"tags": {"latest": "1.0"}, "updatedAt": 1700000000500, "createdAt": 1600000000500, "displayName": "S@k", "summary": "s", "stats": {"downloads": 5, "stars": 2, "versions": 3}}}],
        {"ecosystem": "clawhub", "name": "group/n@k", "version": "1.0", "published_at": 1700000000, "first_published_at": 1600000000, "title": "S@k", "description": "s", "downloads_total": 5, "rating_count": 2, "release_count": 3}),
    "oci": ("1.25", [{"name": "n@k", "namespace": "library", "last_updated": _D2, "date_registered": _D1, "description": "d", "pull_count": 100, "star_count": 9}],
        {"ecosystem": "oci", "name": "n@k", "version": "", "published_at": _S2, "first_published_at": _S1, "author": "library", "description": "d", "downloads_total": 100, "rating_count": 9}),
    "snap": (None, [{"name": "other", "snap": {"title": "T@k", "summary": "s", "description": "long", "license": "MIT", "publisher": {"display-name": "P@k"}, "store-url": "https://store"}, "channel-map": [
        {"version": "2-edge", "channel": {"track": "latest", "risk": "edge", "released-at": _D3}}, {"version": "1.0", "channel": {"track": "latest", "risk": "stable", "released-at": "2024-02-02T03:04:05.123456+00:00"}}]}],
        {"ecosystem": "snap", "name": "group/n@k", "version": "1.0", "published_at": _S2, "author": "P@k", "title": "T@k", "description": "s", "homepage": "https://store", "license": "MIT"}),
    "wordpress": (None, [{"slug": "n@k", "version": "1.2", "last_updated": "2024-01-01 5:00pm GMT", "author": "<a href=x>Dev @k</a>", "name": "N", "homepage": "https://h", "downloaded": 70, "rating": 90, "num_ratings": 3}],
        {"ecosystem": "wordpress", "name": "n@k", "version": "1.2", "published_at": _S1, "author": "Dev @k", "title": "N", "homepage": "https://h", "downloads_total": 70, "rating": 4.5, "rating_count": 3}),
    "huggingface": (None, [{"id": "o/m@k", "sha": "abc@k", "lastModified": _D2, "createdAt": _D1, "author": "o", "tags": ["x", "license:apache-2.0"], "downloads": 40, "likes": 5}],
        {"ecosystem": "huggingface", "name": "o/m@k", "version": "abc@k", "published_at": _S2, "first_published_at": _S1, "author": "o", "homepage": "https://huggingface.co/o/m@k", "license": "apache-2.0", "downloads_recent": 40, "rating_count": 5}),
    "firefox": (None, [{"slug": "n@k", "current_version": {"version": "2.0", "reviewed": None, "license": {"name": {"de": "Lizenz", "en-US": "MPL"}}}, "last_updated": _D2, "created": _D1, "authors": [{"name": "A@k"}, {"name": "B"}], "name": {"en-US": "", "fr": "Nom @k"}, "summary": "s",
        "homepage": {"url": {"en-US": "https://h"}}, "average_daily_users": 20, "weekly_downloads": 4, "ratings": {"average": 4.5, "count": 8}, "is_disabled": True}, {"results": [{"reviewed": _D2}, {"created": _D1}]}],
        {"ecosystem": "firefox", "name": "n@k", "version": "2.0", "published_at": _S2, "first_published_at": _S1, "previous_published_at": _S1, "release_count": 2, "author": "A@k", "maintainers": 2, "title": "Nom @k", "description": "s", "homepage": "https://h", "license": "MPL", "downloads_total": 20,
         "downloads_recent": 4, "rating": 4.5, "rating_count": 8, "deprecated": "disabled"}),
    "jetbrains": (None, [{"xmlId": "x.@k", "vendor": {"name": "V@k"}, "name": "N", "preview": "p", "urls": {"url": "https://u", "sourceCodeUrl": "https://s"}, "downloads": 30, "rating": 4.5}, [{"version": "1.0", "cdate": "1700000000500"}]],
        {"ecosystem": "jetbrains", "name": "x.@k", "version": "1.0", "published_at": 1700000000, "author": "V@k", "title": "N", "description": "p", "homepage": "https://u", "repository": "https://s", "downloads_total": 30, "rating": 4.5}),
    "netbsd": (None, ["PKGNAME=group/n@k-1.2nb3~COMMENT=d@k~HOMEPAGE=https://h~LICENSE=mit~MAINTAINER=m@x.y~BUILD_DATE=2024-02-02 03:04:05 +0000"], {"ecosystem": "netbsd", "name": "group/n@k", "version": "1.2nb3", "published_at": _S2, "author": "m@x.y", "description": "d@k", "homepage": "https://h", "license": "mit"}),
    "freebsd": (None, [{"name": "group/n@k", "version": "1.@k", "maintainer": "M <m@x.y>", "comment": "c", "www": "https://h", "licenses": ["BSD"]}], {"ecosystem": "freebsd", "name": "group/n@k", "version": "1.@k", "author": "M", "description": "c", "homepage": "https://h", "license": "BSD"}),
    "openbsd": (None, ["-rw-r--r-- 1 root 10 n@k-1.2p3.tgz"], {"ecosystem": "openbsd", "name": "n@k", "version": "1.2p3"}, "n@k"),
} | {
    e: (None, ["C:x~P:n@k~V:1.@k-r0~T:d~U:https://u~L:MIT~m:A @k <a@b.c>~t:1700000000"], {"ecosystem": e, "name": "n@k", "version": "1.@k-r0", "published_at": 1700000000, "author": "A @k", "description": "d", "homepage": "https://u", "license": "MIT"}, "n@k") for e in ("alpine", "wolfi")
} | {
    e: (None, ["Package: n@k~Version: 1.@k-2~Maintainer: A @k <a@b.c>~Description: d~Homepage: https://h"], {"ecosystem": e, "name": "n@k", "version": "1.@k-2", "author": "A @k", "description": "d", "homepage": "https://h"}, "n@k") for e in ("debian", "ubuntu")
} | {
    e: (None, ['<package type="rpm"><name>n@k</name><version epoch="0" ver="1.@k" rel="2"/><summary>s &amp; t</summary><packager>p@k</packager><url>https://u</url><time file="5" build="1700000000"/><format><rpm:license>MIT</rpm:license></format></package>'],
        {"ecosystem": e, "name": "n@k", "version": "1.@k-2", "published_at": 1700000000, "author": "p@k", "description": "s & t", "homepage": "https://u", "license": "MIT"}, "n@k") for e in ("opensuse", "rpmfusion")
}


def _pair(value, second: bool):
    return value[second] if isinstance(value, tuple) else value


def _odd(kind: str, *documents) -> None:
    """Further documents of a kind: (version asked for, bodies, record or None[, path]); a record begins with the name and an empty version."""
    for version, bodies, record, *path in documents:
        path = path[0] if path else PATH
        whole = None if record is None else {"ecosystem": ECOSYSTEM.get(kind, kind), "name": path, "version": ""} | record
        ODD.setdefault(kind, []).append((path, version, bodies, whole))


ECOSYSTEM = {"cargo": "crates"}
#: kind -> [(path, version, bodies, record)]; no record where the document is none of the asked package's.
ODD: dict[str, list] = {}
_odd("npm",
    (None, [{"description": "security holding package", "dist-tags": {}, "time": {"created": _D1, "0.0.1": _D1, "unpublished": {"time": _D2}}, "maintainers": None}],
        {"description": "security holding package", "maintainers": 0, "security_hold": True, "version_removed": False, "release_count": 1, "first_published_at": _S1}),
    ("1.0", [{"versions": {"1.0": {"deprecated": True, "author": "Ann @k", "description": "", "homepage": None, "repository": "text", "scripts": {"preinstall": "x"}, "_npmUser": {"name": "zed", "email": "z@Ex.Com>"}}},
        "description": "root", "homepage": "https://r", "repository": {"url": "https://g"}, "maintainers": ["ann", "bob"], "license": "MIT"}],
        {"version": "1.0", "author": "Ann @k", "deprecated": "deprecated", "license": "MIT", "repository": "https://g", "maintainers": 2, "security_hold": False, "version_removed": False, "publisher": "zed", "publisher_email_domain": "ex.com", "publisher_in_maintainers": False, "has_install_script": True}),
    (None, [{"dist-tags": {"latest": "2.0"}, "versions": {"2.0": {"hasInstallScript": True, "dist": {"fileCount": 3, "unpackedSize": 9}, "deprecated": "old @k"}}, "author": {"name": "R"}, "maintainers": [{"name": "m"}], "time": {"2.0": _D2, "1.0": _D1, "3.0": _D3}}, {"downloads": 5}],
        {"version": "2.0", "latest_version": "2.0", "published_at": _S2, "previous_published_at": _S1, "release_count": 3, "first_published_at": _S1, "author": "R", "deprecated": "old @k", "maintainers": 1, "security_hold": False, "version_removed": False, "file_count": 3, "unpacked_size": 9, "has_install_script": True, "downloads_recent": 5}),
    ("9", [{"time": {"9": _D2}, "maintainers": [{"name": "m@k"}]}], {"version": "9", "published_at": _S2, "author": "m@k", "release_count": 1, "first_published_at": _S2, "maintainers": 1, "security_hold": False, "version_removed": True}, "%40sc/n@k"))
ODD["npm"][-1][3]["name"] = "@sc/n@k"
_odd("cargo",
    (None, [{"crate": {"max_stable_version": None, "max_version": "3.0", "created_at": _D1}}], {"published_at": _S1}),
    ("1", [{"crate": {"max_version": "2", "created_at": _D2, "downloads": -1}, "versions": [{"num": "1", "created_at": None, "yanked": False}]}], {"version": "1", "latest_version": "2"}),
    ("7", [{"crate": {"created_at": _D2, "description": 5}, "versions": None}], {"version": "7", "published_at": _S2}),
    (None, [{"errors": []}], None))
_odd("homebrew",
    (None, [{"analytics": {"install": {"30d": {}}}, "deprecated": True, "disabled": True}], {"downloads_recent": 0, "deprecated": "deprecated"}),
    (None, [{"name": "f@k", "versions": {"stable": None}, "analytics": {"install": {"30d": {"a": "5", "b": 2, "c": -1}}}, "disabled": True}], {"name": "f@k", "downloads_recent": 2, "deprecated": "disabled"}),
    (None, [{"analytics": {"install": {"30d": []}}, "deprecated": "yes"}], {}))
_odd("pypi",
    (None, [{"info": {"version": None, "author": None, "maintainer": "", "author_email": "", "maintainer_email": "x@@Y.Example>"}, "urls": [{"upload_time_iso_8601": _D2, "yanked": True}, {"upload_time_iso_8601": _D1}]}],
        {"published_at": _S1, "deprecated": "yanked", "publisher_email_domain": "y.example"}),
    (None, [{"info": {}, "releases": {}, "ownership": {"roles": []}}], {"release_count": 0}),
    ("5", [{"info": {"version": "1", "summary": ""}, "releases": {"1": [], "2": [{"upload_time_iso_8601": "soon"}]}, "vulnerabilities": {}}], {"version": "5", "latest_version": "1", "description": "", "release_count": 0}),
    (None, [{"message": "none"}], None))
_odd("composer",
    ("v3", [{"package": {"versions": {"3.0": {"version": "3.0"}, "vv3": {"version": "3", "license": [], "authors": [{}]}}}}], {"version": "3"}),
    (None, [{"package": {"description": None, "favers": -1, "maintainers": {}}}], {}),
    (None, [{"packages": {}}], None))
_odd("gem",
    (None, [{"version": None, "licenses": [None, "MIT"], "downloads": "12"}], {}),
    ("7", [{"authors": 5}, []], {"version": "7"}),
    ("9.9", [{"info": ""}, [{"number": "1", "created_at": _D2}, {"number": "2", "created_at": _D1}]], {"version": "9.9", "description": "", "published_at": _S2}))
_odd("golang",
    ("v9", [{"Time": "garbage"}], {}),
    (None, [{"Version": "v2", "Time": "2024-02-02T03:04:05+02", "Origin": {}}], {"version": "v2", "published_at": _S2 - 7200}),
    (None, [{"Version": "v3", "Time": "2024-02-02 03:04:05.5-01:30 x"}], {"version": "v3", "published_at": _S2 + 5400}))
_odd("github", (None, [{"homepage": None, "license": None, "archived": False, "stargazers_count": 1.5}], {}), (None, [{"license": {"spdx_id": ""}, "archived": "yes", "description": ""}], {"license": "", "description": ""}))
_odd("aur", (None, [{"results": [{"OutOfDate": 0, "Maintainer": None, "CoMaintainers": None}]}], {"maintainers": 0}), (None, [{"results": [{"OutOfDate": None, "CoMaintainers": ["x"], "Version": 5}]}], {"maintainers": 1}), (None, [{"results": []}], None))
_odd("chrome",
    (None, ['<meta property="og:title" content=" T@k  - Chrome Web Store - Chrome Web Store"><meta property="og:description" content="">Updated</div> > <div>June 9, 2026</div>x users 4.9.1 out of 5 stars'],
        {"name": "n@k", "title": "T@k", "description": "", "published_at": secs("2026-06-09T00:00:00Z"), "homepage": "https://chromewebstore.google.com/detail/n@k"}),
    (None, ["Updated <b> </b>Jun 9, 2026</b> Offered by<<i>\u00a0Dev @k\u2003<b> 1,2,3 users"], {"name": "n@k", "author": "Dev @k", "downloads_total": 123, "homepage": "https://chromewebstore.google.com/detail/n@k"}))
_odd("openvsx",
    ("2", [{"namespaceAccess": "PUBLIC", "deprecated": True, "allVersions": [1, 2], "averageRating": 4, "namespace": "other", "name": "other"}], {"name": "group.n@k", "publisher_verified": False, "rating": 4, "deprecated": "deprecated"}),
    (None, [{"namespaceAccess": "Restricted", "allVersions": {}, "timestamp": None}], {"name": "group.n@k", "publisher_verified": True, "release_count": 0}),
    (None, [{"version": "1"}], None, "plain@k"))
_odd("vscode",
    (None, [{"results": [{"extensions": [{"statistics": [{"statisticName": "install", "value": 12.9}, {"statisticName": "install", "value": 1}], "versions": [], "lastUpdated": "2024-02-02T03:04:05.123Z"}]}]}], {"name": "group.n@k", "published_at": _S2, "downloads_total": 12}),
    (None, [{"results": [{"extensions": [{"lastUpdated": _D1, "versions": [{"version": "2", "lastUpdated": _D1}, {"version": "1", "lastUpdated": _D3}]}]}]}], {"name": "group.n@k", "version": "2", "published_at": _S1, "release_count": 2}),
    (None, [{"results": [{"extensions": []}]}], None))
_odd("nuget",
    ("9", [{"data": [{"version": "2.0", "versions": [{"version": "1.0"}], "authors": "One @k", "deprecation": {"reasons": ["x"]}, "projectUrl": None}]}, None,
        "<n:package xmlns:n='u'><n:metadata><n:license type='expression'> MIT OR X </n:license><n:repository url='https://g/@k' commit='' /></n:metadata></n:package>"],
        {"version": "2.0", "latest_version": "2.0", "author": "One @k", "deprecated": "deprecated", "license": "MIT OR X", "repository": "https://g/@k"}),
    ("1.0", [{"data": [{"version": "2.0", "versions": [{"version": "1.0"}], "deprecation": None}]}, {"items": [{"items": [{"catalogEntry": {"version": "0.1", "published": _D1}}, {"catalogEntry": {"version": "1.0", "licenseExpression": "", "deprecation": {"message": "use other"}}}]}]},
        '<package><license type="expression">MIT</license>'],
        {"version": "1.0", "latest_version": "2.0", "deprecated": "use other", "release_count": 1, "first_published_at": _S1}),
    (None, [{"data": []}], None))
_odd("maven", ("1.0", [{"response": {"docs": [{"timestamp": -5}]}}], {"name": "group:n@k"}), (None, [{"response": {"docs": []}}], None), (None, [{"response": {"docs": [{"v": "1"}]}}], None, "plain@k"))
_odd("hex",
    (None, [{"latest_stable_version": None, "latest_version": "1.1", "releases": [{"version": "x", "inserted_at": "bad"}], "inserted_at": _D1, "meta": {"links": {"Zed": "https://z", "A": 5, "Blog": "https://b"}}}], {"published_at": _S1, "repository": "https://b"}),
    ("3", [{"latest_version": "2", "meta": None, "downloads": {"all": "x"}}], {"version": "3", "latest_version": "2"}))
_odd("cran", (None, [{"Package": None, "Maintainer": "<only@x.y>", "URL": " \n\t\n https://b, https://c\u00a0\nhttps://d", "Date/Publication": "2024-02-02"}], {"author": "", "homepage": "https://b, https://c"}), (None, [{"URL": " ", "Title": ""}], {"description": ""}))
_odd("cpan", (None, [{"status": "latest", "license": [], "resources": {}, "version": 1.5}], {}), (None, [{"distribution": "", "date": "2024-02-02T03:04:05.123"}], {"name": "", "published_at": _S2}))
_odd("pub", ("7", [{"latest": {"version": "1.0", "pubspec": {"homepage": None}}}], {"version": "1.0", "latest_version": "1.0"}), (None, [{}], {}))
_odd("conda", ("5", [{"files": [], "source_git_url": "https://s@k", "dev_url": "https://d"}], {"version": "5", "repository": "https://s@k"}), (None, [{"files": [{"version": "2", "upload_time": "bad"}], "latest_version": "2", "created_at": _D1}], {"version": "2", "latest_version": "2", "published_at": _S1}))
_odd("clojars",
    ("0.1", [{"group_name": None, "jar_name": "j@k", "latest_release": None, "latest_version": "2"}], {"name": "j@k", "latest_version": "2"}),
    (None, [{"group_name": "g", "jar_name": "j@k", "latest_version": "3"}], {"name": "g/j@k", "version": "3", "latest_version": "3"}),
    (None, [{"group_name": "g", "licenses": []}], {}))
_odd("jsr", (None, [{"githubRepository": {"owner": "o"}, "score": "x"}, []], {"name": "@sc/n@k"}, "%40sc/n@k"), ("8", [{"latestVersion": None}, [{"version": "1", "createdAt": _D2}]], {"name": "@group/n@k", "version": "8", "published_at": _S2}), (None, [{}], None, "@plain@k"))
_odd("arch", (None, [{"results": [{"pkgrel": "3", "last_update": None, "build_date": "2024-01-01T00:00:00.1Z", "maintainers": None, "licenses": []}]}], {"published_at": _S1}), (None, [{"results": [{"pkgver": "2", "flag_date": None}]}], {"version": "2"}))
_odd("fedora", (None, [{"basename": None, "version": "1", "license": "", "summary": None, "description": "long @k"}], {"version": "1", "description": "long @k"}), (None, [{"release": "2"}], {}))
_odd("clawhub", (None, [{"skill": {"updatedAt": 1700000000999.75, "createdAt": "x", "stats": {"versions": -1}}}], {"published_at": 1700000000}), (None, [{"error": "none"}], None))
_odd("oci",
    (None, [{"namespace": "q", "last_modified": 1700000000, "popularity": 2.5, "description": ""}], {"name": "n@k", "published_at": 1700000000, "author": "q"}),
    ("1", [{"namespace": None, "user": "u@k", "name": "", "last_updated": "2024-02-02 03:04:05 UTC"}], {"name": "", "published_at": _S2}))
_odd("snap",
    (None, [{"snap": {"website": "", "store-url": "https://s", "license": "", "summary": None, "description": "d"}, "channel-map": []}], {"homepage": "https://s", "description": "d"}),
    (None, [{"snap": None, "channel-map": [{"version": "3", "channel": {"track": "1", "risk": "stable"}}]}], {"version": "3"}),
    (None, [{"snap": {"website": "https://w", "store-url": "https://s"}}], {"homepage": "https://w"}),
    (None, [{"error-list": []}], None))
_odd("wordpress", (None, [{"homepage": "", "author": "A > <b>B@k<", "last_updated": "2024", "rating": "x"}], {"author": "A  B@k"}), (None, [{"slug": "", "author": "<a></a>", "rating": 0}], {"name": "", "author": "", "rating": 0}))
_odd("huggingface",
    ("rev", [{"license": "mit", "cardData": {"license": "x"}, "tags": ["license:y"]}], {"version": "rev", "license": "mit", "homepage": "https://huggingface.co/group/n@k"}),
    (None, [{"cardData": {"license": ["a"]}, "tags": [5, "license:", "license:z"]}], {"license": "", "homepage": "https://huggingface.co/group/n@k"}),
    (None, [{"license": None, "cardData": {"license": "gpl"}}], {"license": "gpl", "homepage": "https://huggingface.co/group/n@k"}))
_odd("firefox",
    (None, [{"authors": "x", "name": {"de": "", "es": "Nom @k", "aa": 5}, "summary": "", "homepage": None, "last_updated": _D2, "current_version": {"version": "1"}}, {"results": [{"reviewed": None, "created": _D1}, {"created": _D3}]}], {"version": "1", "published_at": _S2, "title": "Nom @k", "release_count": 1}),
    (None, [{"name": {"en-US": "E", "de": "D"}, "authors": [], "is_disabled": False}, {"results": []}], {"title": "E", "maintainers": 0}))
_odd("jetbrains",
    (None, [{"vendor": 5, "urls": {"url": "", "sourceCodeUrl": None}}, []], {}),
    (None, [{"vendor": "V@k", "rating": 4}, [{"version": "1", "cdate": 1700000000999}]], {"version": "1", "published_at": 1700000000, "author": "V@k", "rating": 4}),
    (None, [{"vendor": {}}, [{"cdate": "x"}]], {}))
for _e in ("alpine", "wolfi"):
    _odd(_e, (None, ["P:other~V:1"], None, "n@k"), (None, ["V:2~P: n@k\t~t:0~m:<a@b>~L:~U:\u00a0"], {"version": "2", "author": ""}, "n@k"), (None, ["P:n@k~XV:9~V:"], {}, "n@k"), (None, ["V:1~T:P:n@k"], None, "n@k"))
for _e in ("debian", "ubuntu"):
    _odd(_e, (None, ["Package: other~Version: 1"], None, "n@k"), (None, ["Package:\tn@k~Version:~Description: d~ Version: 9"], {"description": "d"}, "n@k"), (None, ["Package: n@k-dev~Version: 1"], None, "n@k"))
for _e in ("opensuse", "rpmfusion"):
    _odd(_e, (None, ["<package><name>other</name></package>"], None, "n@k"),
        (None, ['<package><name> n@k </name><version ver="2"/><time build="0"/><rpm:vendor></rpm:vendor><packager>p</packager><summary lang="x">s</summary></package>'], {"version": "2", "author": ""}, "n@k"),
        (None, ["<package><name>n@k</name><packager>&lt;p&gt; &amp;amp;</packager></package>"], {"author": "<p> &amp;"}, "n@k"))
_odd("netbsd", (None, ["PKGNAME=other-1.0"], None, "n@k"), (None, ["PKGNAME=n@k-bar-1.0~MAINTAINER=A <a@b>~BUILD_DATE=bad~COMMENT= "], {"version": "bar-1.0", "author": "A"}, "n@k"), (None, ["PKGNAME=n@k"], None, "n@k"))
_odd("freebsd", (None, [{"name": "other"}], None, "n@k"), (None, [{"name": "n@k", "maintainer": "<x@y>", "licenses": []}], {"author": ""}, "n@k"))
_odd("openbsd", (None, ["drwx n@k-bar-2.0.tgz~x pool/n@k-1.5p0.tgz~n@k-1.6.tgz"], {"version": "1.5p0"}, "n@k"), (None, ["n@k-bar.tgz other-1.tgz n@k-1.tar"], None, "n@k"))


def documents(kind: str) -> list:
    """(path, version, bodies, record) of all documents of a kind."""
    out = []
    if kind in CASES:
        version, bodies, record, *path = CASES[kind]
        for second in (False, True)[: 1 if version is None else 2]:
            out.append((path[0] if path else PATH, version if second else None, bodies, {f: _pair(v, second) for f, v in record.items()}))
    return out + ODD.get(kind, [])


def _run(kind: str):
    given = documents(kind)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = readers.spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"))
        docs = part.select(*[_given(given, i).alias(c) for i, c in enumerate(("name", "version", "body", "body2", "body3"))])
        return registry.normalize(docs, kind).select(*FIELDS)

    return query


def _oracle(kind: str) -> str:
    given = documents(kind)
    told = [(i, record) for i, (_, _, _, record) in enumerate(given) if record is not None]

    def field(f: str) -> str:
        values = [(i, record.get(f)) for i, record in told]
        if len({repr(v) for _, v in values}) == 1:
            return _expected(f, values[0][1])
        return "CASE n " + " ".join(f"WHEN {i} THEN {_expected(f, v)}" for i, v in values) + " END"

    chosen = ", ".join(str(i) for i, _ in told)
    return f"WITH inp AS (SELECT p_partkey AS k, p_partkey % {len(given)} AS n FROM part) SELECT {', '.join(f'{field(f)} AS {f}' for f in FIELDS)} FROM inp WHERE n IN ({chosen})"


QUERIES: dict = {}
ORACLES: dict = {}
for _kind in CASES | ODD:
    _name = f"registry_{_kind}" if _kind in CASES else f"registry_{_kind}_documents"
    QUERIES[_name] = _run(_kind)
    ORACLES[_name] = _oracle(_kind)
