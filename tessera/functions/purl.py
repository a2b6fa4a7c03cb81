"""Package-URL functions as column expressions.

All are native expressions without Python workers. Null input gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, group_of, lower_ascii, replace_all, rx, trim

#: Legacy distribution types -> (type of the specification, vendor namespace).
DISTRO_SPECS = {
    "debian": ("deb", "debian"),
    "ubuntu": ("deb", "ubuntu"),
    "fedora": ("rpm", "fedora"),
    "opensuse": ("rpm", "opensuse"),
    "rpmfusion": ("rpm", "rpmfusion"),
    "arch": ("alpm", "arch"),
    "aur": ("alpm", "aur"),
    "alpine": ("apk", "alpine"),
    "wolfi": ("apk", "wolfi"),
}

_SPLIT = r"(?is)^pkg:([^/]*)/(.*)$"
_BODY = r"(?s)^(@[^/@?]*/[^@?]*|[^@?]*)((?:[@?].*)?)$"


def purl_type(purl) -> Column:
    """Lower-cased type; null without the ``pkg:`` scheme (any case) or a slash."""
    return lower_ascii(group_of(trim(purl), _SPLIT, 1))


def purl_rest(purl) -> Column:
    """What follows ``pkg:<type>/``."""
    return group_of(trim(purl), _SPLIT, 2)


def last_segment(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def normalize_pypi(name) -> Column:
    """PEP 503: ASCII lower case, each run of ``- _ .`` as one hyphen."""
    return lower_ascii(replace_all(name, "[-_.]+", "-"))


def goproxy_escape(module) -> Column:
    """Upper-case ASCII letters as ``!`` and the lower-case letter."""
    return lower_ascii(replace_all(module, "([A-Z])", "!$1"))


def goproxy_unescape(module) -> Column:
    """The inverse of :func:`goproxy_escape`; a last lone ``!`` drops out."""
    parts = F.split(col(module), "!")
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))


def _qualifiers(tail) -> Column:
    return F.split(group_of(tail, r"(?s)^[^?]*\?(.*)$"), "&")


def _key(q: Column) -> Column:
    return lower_ascii(F.substring_index(q, "=", 1))


def qualifier_of(tail, key: str) -> Column:
    """Raw value of the first qualifier with that key (any case); '' if it has none, null if absent."""
    found = F.filter(_qualifiers(tail), lambda q: _key(q) == key)
    first = F.get(found, F.lit(0))
    return F.when(F.instr(first, "=") > 0, F.substring(first, F.instr(first, "=") + 1, F.length(first))).when(first.isNotNull(), F.lit(""))


def without_qualifier(tail, key: str) -> Column:
    """The tail without the first qualifier of that key."""
    parts = _qualifiers(tail)
    place = F.array_position(F.transform(parts, _key), key) - 1
    kept = F.filter(parts, lambda _, i: i != place)
    head = F.substring_index(col(tail), "?", 1)
    return F.when(F.coalesce(place, F.lit(-1)) < 0, col(tail)).when(F.size(kept) == 0, head).otherwise(F.concat(head, F.lit("?"), F.array_join(kept, "&")))


def with_qualifier(tail, key: str, value: str) -> Column:
    """The tail with a qualifier added unless its key is there."""
    there = F.coalesce(F.exists(_qualifiers(tail), lambda q: _key(q) == key), F.lit(False))
    glue = F.when(F.instr(col(tail), "?") > 0, "&").otherwise("?")
    return F.when(there, col(tail)).otherwise(F.concat(col(tail), glue, F.lit(f"{key}={value}")))


def _spec(kind, part: int) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in DISTRO_SPECS.items() for x in (k, v[part])])
    return table[col(kind)]


def normalize(df: DataFrame, purl, out: str = "normalized") -> DataFrame:
    """Append the canonical package URL, null where the input isn't one; narrow, in a few staged projections."""
    t = {n: f"__{out}_{n}" for n in ("type", "rest", "path", "tail", "space")}
    c = {k: F.col(v) for k, v in t.items()}
    df = df.withColumns({t["type"]: purl_type(purl), t["rest"]: purl_rest(purl)})
    df = df.withColumns({t["path"]: F.regexp_extract(c["rest"], _BODY, 1), t["tail"]: F.regexp_extract(c["rest"], _BODY, 2)})
    valid = (c["type"] != "") & (last_segment(c["path"]) != "")
    df = df.withColumns({
        t["tail"]: F.regexp_replace(c["tail"], F.lit(r"(?s)^\?(.*)@([^@=&/]+)$"), F.lit("@$2?$1")),
        t["path"]: F.when(valid, F.regexp_replace(c["path"], F.lit("^@"), F.lit("%40"))),
    })
    vendor = lower_ascii(F.substring_index(qualifier_of(c["tail"], "distro"), "-", 1))
    namespaced = F.concat(lower_ascii(F.substring_index(c["path"], "/", 1)), F.substring(c["path"], F.instr(c["path"], "/"), F.length(c["path"])))
    df = df.withColumn(t["path"], F.when(c["type"].isin("deb", "rpm", "apk", "alpm"), F.when(F.instr(c["path"], "/") > 0, namespaced).when((_spec(vendor, 0) == c["type"]) & (_spec(vendor, 1) == vendor), F.concat(vendor, F.lit("/"), c["path"])).otherwise(c["path"])).otherwise(c["path"]))
    aur = F.coalesce(F.contains(qualifier_of(c["tail"], "repository_url"), F.lit("aur.archlinux.org")), F.lit(False))
    rest = without_qualifier(c["tail"], "repository_url")
    name, lower = last_segment(c["path"]), lower_ascii(c["path"])
    spec = _spec(c["type"], 0)
    own = F.when(spec == "rpm", name).otherwise(lower_ascii(name))
    full = (
        F.when(c["type"].isin("chrome", "chrome-extension"), F.concat(F.lit("pkg:chrome-extension/"), lower_ascii(name), c["tail"]))
        .when(c["type"].isin("vscode", "vscode-extension"), F.concat(F.lit("pkg:vscode-extension/"), lower, c["tail"]))
        .when(c["type"] == "openvsx", F.concat(F.lit("pkg:vscode-extension/"), lower, with_qualifier(c["tail"], "repository_url", "https://open-vsx.org")))
        .when(c["type"] == "pypi", F.concat(F.lit("pkg:pypi/"), normalize_pypi(c["path"]), c["tail"]))
        .when(c["type"] == "composer", F.concat(F.lit("pkg:composer/"), lower, c["tail"]))
        .when((c["type"] == "alpm") & aur, F.concat(F.lit("pkg:alpm/aur/"), lower_ascii(name), rest))
        .when((c["type"] == "alpm") & c["path"].startswith("aur/"), F.concat(F.lit("pkg:alpm/"), lower, c["tail"]))
        .when((spec == "alpm") & aur, F.concat(F.lit("pkg:alpm/aur/"), own, rest))
        .when(spec.isNotNull(), F.concat(F.lit("pkg:"), spec, F.lit("/"), _spec(c["type"], 1), F.lit("/"), own, c["tail"]))
        .otherwise(F.concat(F.lit("pkg:"), c["type"], F.lit("/"), c["path"], c["tail"]))
    )
    return df.withColumn(out, F.when(c["path"].isNotNull(), full)).drop(*t.values())


def identity_of(normalized) -> Column:
    """A canonical package URL with no qualifiers but ``repository_url``."""
    kept = F.filter(_qualifiers(normalized), lambda q: _key(q) == "repository_url")
    head = F.substring_index(col(normalized), "?", 1)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.concat(head, F.lit("?"), F.array_join(kept, "&"))).otherwise(head)


def identity(df: DataFrame, purl, out: str = "identity") -> DataFrame:
    step = f"__{out}_n"
    return normalize(df, purl, step).withColumn(out, identity_of(step)).drop(step)


def parse(purl) -> dict[str, Column]:
    """Columns ``type``, ``path`` and ``version``: qualifiers cut at the first ?, version after the last @.

    A version written behind the qualifiers (``?q@v``) is taken if it holds none of ``= & /``.
    """
    rest = purl_rest(purl)
    body = F.substring_index(rest, "?", 1)
    late = rx(rest, r"(?s)^[^@?]*\?(?:.*)@([^@=&/]+)$")
    ahead = F.instr(body, "@") > 0
    version = F.when(ahead, F.nullif(F.substring_index(body, "@", -1), F.lit(""))).otherwise(late)
    path = F.when(ahead, F.regexp_extract(body, r"(?s)^(.*)@[^@]*$", 1)).otherwise(body)
    return {"type": purl_type(purl), "path": path, "version": version}


def coordinate(purl) -> Column:
    """A package URL without its version: the text before the last @."""
    return F.when(F.instr(col(purl), "@") > 0, F.regexp_extract(col(purl), r"(?s)^(.*)@[^@]*$", 1)).otherwise(col(purl))


def is_web_scheme(url) -> Column:
    return col(url).rlike(r"(?i)^https?://")


def split_host(url) -> Column:
    """Host of an http(s) URL (scheme in lower case), without its port."""
    return group_of(url, r"(?s)^https?://([^/:]*)[^/]*(?:/.*)?$")


def split_path(url) -> Column:
    """Path without the leading slash, query and fragment."""
    return group_of(url, r"(?s)^https?://[^/]*/?([^?#]*).*$")


def url_to_purl(df: DataFrame, url, out: str = "purl") -> DataFrame:
    """Append the package URL that an artifact URL of a known registry stands for, else null."""
    h, p = f"__{out}_host", f"__{out}_path"
    df = df.withColumns({h: lower_ascii(split_host(url)), p: split_path(url)})
    host, path = F.col(h), F.col(p)
    both = lambda kind, pattern, name=1, version=2: F.when(path.rlike(pattern), F.concat(F.lit(f"pkg:{kind}/"), F.regexp_extract(path, pattern, name), F.lit("@"), F.regexp_extract(path, pattern, version)))
    npm_name = group_of(path, r"^(.*?)/-/.*\.tgz$")
    stem = group_of(path, r"^.*?/-/(.*)\.tgz$")
    npm_base = F.concat(last_segment(npm_name), F.lit("-"))
    npm = F.when(F.startswith(stem, npm_base), F.concat(F.lit("pkg:npm/"), F.replace(npm_name, F.lit("@"), F.lit("%40")), F.lit("@"), F.substring(stem, F.length(npm_base) + 1, F.length(stem))))
    crate, file = group_of(path, r"^crates/([^/]*)/.*$"), group_of(path, r"^crates/[^/]*/(.*)\.crate$")
    crate_base = F.concat(crate, F.lit("-"))
    cargo = F.when(path.startswith("crates/"), F.when(F.startswith(file, crate_base), F.concat(F.lit("pkg:cargo/"), crate, F.lit("@"), F.substring(file, F.length(crate_base) + 1, F.length(file))))).otherwise(both("cargo", r"^api/v1/crates/([^/]*)/([^/]*)/download(?:/.*)?$"))
    last = last_segment(path)
    wheel, sdist = r"^([^-]*)-([^-]*)(?:-.*)?\.whl$", r"^(.*)-([0-9][^-]*)(?:\.tar\.gz|\.tar\.bz2|\.tar\.xz|\.zip|\.tgz)$"
    py = lambda pattern: F.when(last.rlike(pattern), F.concat(F.lit("pkg:pypi/"), normalize_pypi(F.regexp_extract(last, pattern, 1)), F.lit("@"), F.regexp_extract(last, pattern, 2)))
    go = r"^(.*?)/@v/(.*)\.zip$"
    golang = F.when(path.rlike(go), F.concat(F.lit("pkg:golang/"), goproxy_unescape(F.regexp_extract(path, go, 1)), F.lit("@"), goproxy_unescape(F.regexp_extract(path, go, 2))))
    segments = F.filter(F.split(group_of(path, r"^maven2/(.*)$"), "/"), lambda s: s != "")
    n = F.size(segments)
    maven = F.when(n >= 4, F.concat(F.lit("pkg:maven/"), F.array_join(F.slice(segments, 1, F.greatest(n - 3, F.lit(0))), "."), F.lit("/"), F.get(segments, n - 3), F.lit("@"), F.get(segments, n - 2)))
    return df.withColumn(out, (
        F.when(host.isin("registry.npmjs.org", "registry.yarnpkg.com"), npm)
        .when(host.isin("static.crates.io", "crates.io"), cargo)
        .when(host == "files.pythonhosted.org", F.coalesce(py(wheel), py(sdist)))
        .when(host == "rubygems.org", both("gem", r"^(?:downloads|gems)/(.*)-([0-9][^-]*)\.gem$"))
        .when(host == "proxy.golang.org", golang)
        .when(host == "api.nuget.org", both("nuget", r"^v3-flatcontainer/([^/]*)/([^/]*)(?:/.*)?$"))
        .when(host.isin("repo1.maven.org", "repo.maven.apache.org"), maven)
        .when(host == "codeload.github.com", F.when(path.rlike(r"^[^/]*/[^/]*/(?:tar\.gz|zip)/[^/]*"), F.regexp_replace(path, F.lit(r"^([^/]*)/([^/]*)/(?:tar\.gz|zip)/([^/]*).*$"), F.lit("pkg:github/$1/$2@$3"))))
    )).drop(h, p)


def safe_coordinate(path) -> Column:
    """Whether a path may be put in a URL: no dot segments, blanks, control characters or any of ``\\ ? # "``."""
    return F.coalesce(~col(path).rlike(r"(?:^|/)\.{1,2}(?:/|$)") & ~col(path).rlike(r'[\x00-\x20\x7f\\?#"]'), F.lit(False))


def safe_filename_part(name) -> Column:
    """Whether a string may be part of one path segment: not empty, and none of ``/ \\ ? #``."""
    return F.coalesce((col(name) != "") & ~col(name).rlike(r"[/\\?#]"), F.lit(False))


def purl_qualifier(purl, key: str) -> Column:
    """Raw value of one qualifier of a package URL (see :func:`tessera.functions.scalars.percent_decoded`)."""
    return qualifier_of(purl_rest(purl), key)
