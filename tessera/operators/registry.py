"""Registry documents to one record of 33 fields, one normalizer an ecosystem.

A normalizer maps ``asked(name, version)`` plus the JSON, XML, HTML or stanza bodies it needs to record
fields; all are column expressions over the joined row. Unknown is null, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import jbool, jf64, jlen, jlist, jmap, jparts, jstr, ju64, nonempty, present
from ..functions.purl import last_segment
from ..functions.scalars import (
    email_domain, first_line, grouped_number, meta_content, millis_seconds, month_day_year_seconds, number_before, rfc3339_seconds, sound_xml,
    stanza_field, strip_email, strip_html, tag_attribute, tag_text, text_after, timestamp_seconds, ymd_seconds,
)
from ..functions.text import BLANK, group_of, lower_ascii, trim
from ..sources.stages import meet
from .fetching import recorded

FIELDS = {
    "ecosystem": "string", "name": "string", "version": "string", "published_at": "bigint", "first_published_at": "bigint", "previous_published_at": "bigint",
    "release_count": "bigint", "latest_version": "string", "author": "string", "publisher": "string", "publisher_email_domain": "string", "publisher_in_maintainers": "boolean",
    "publisher_verified": "boolean", "maintainers": "bigint", "title": "string", "description": "string", "homepage": "string", "repository": "string", "repository_commit": "string",
    "license": "string", "deprecated": "string", "security_hold": "boolean", "version_removed": "boolean", "has_install_script": "boolean", "vulnerability_count": "bigint",
    "file_count": "bigint", "unpacked_size": "bigint", "downloads_total": "bigint", "downloads_recent": "bigint", "rating": "float", "rating_count": "bigint",
    "release_times": "array<bigint>", "age_days": "bigint",
}


class Row:
    """Readers over the columns ``name``, ``version`` (asked for; null if none), ``body``, ``body2``, ``body3``."""

    def __init__(self):
        self.name, self.asked = F.col("name"), F.col("version")
        self.doc, self.doc2 = F.col("__doc"), F.col("__doc2")
        self.body, self.body2, self.body3 = F.col("body"), F.col("body2"), F.col("body3")
        self.kept: list[tuple[str, Column]] = []

    def keep(self, value: Column) -> Column:
        """A costly expression as a column of an earlier projection, so that fields share its value."""
        name = f"__kept{len(self.kept)}"
        self.kept.append((name, value))
        return F.col(name)

    def s(self, path: str) -> Column:
        return jstr(self.doc, path)

    def u(self, path: str) -> Column:
        return ju64(self.doc, path)

    def at(self, path: Column) -> Column:
        """A part of the document under a computed path, as VARIANT."""
        return F.try_parse_json(F.call_function("get_json_object", self.body, path))


def key_path(*parts) -> Column:
    """``$['a']['b']`` from names that may be columns."""
    return F.concat(F.lit("$"), *[x for p in parts for x in (F.lit("['"), p if isinstance(p, Column) else F.lit(p), F.lit("']"))])


def previous(times: Column, this: Column) -> Column:
    """Latest time strictly before ``this``."""
    return F.array_max(F.filter(times, lambda t: t < this))


def timeline(times: Column, this: Column, always: bool = False) -> dict[str, Column]:
    """Record fields of a release timeline; ``always`` reports a count of 0 for an empty one."""
    known = F.array_sort(F.array_compact(times))
    some = F.size(known) > 0
    count = F.size(known).cast("bigint")
    return {"release_times": known, "release_count": F.when(times.isNotNull(), count) if always else F.when(some, count), "previous_published_at": previous(known, this)}


def person(doc, path: str) -> Column:
    """A name that is a string or an object with ``name``."""
    return F.coalesce(jstr(doc, path), jstr(doc, f"{path}.name"))


def first_present(reader, *places) -> Column:
    """``reader`` at the first of the ``(doc, path)`` places whose key is there, be it with an explicit null."""
    out = F.lit(None)
    for doc, path in reversed(places):
        out = F.when(present(doc, path), reader(doc, path)).otherwise(out)
    return out


def flag(value: Column, word: str) -> Column:
    return F.when(value, F.lit(word))


def halves(path: Column) -> tuple[Column, Column]:
    """What stands before and after the first slash."""
    return F.substring_index(path, "/", 1), F.substr(path, F.instr(path, "/") + 1)


def release(version: Column, build: Column) -> Column:
    """``version-build``, the version alone, or '' without one."""
    return F.coalesce(F.concat(version, F.lit("-"), build), version, F.lit(""))


def npm(r: Row) -> dict:
    latest = r.s("$['dist-tags'].latest")
    version = F.coalesce(r.asked, latest, F.lit(""))
    v = r.keep(r.at(key_path("versions", version)))
    times = r.keep(F.from_json(F.get_json_object(r.body, "$.time"), "map<string, string>"))
    published = r.keep(rfc3339_seconds(times[version]))
    releases = F.map_values(F.map_filter(times, lambda k, _: ~k.isin("created", "modified")))
    line = timeline(r.keep(F.transform(releases, rfc3339_seconds)), published, True)
    keepers = jlist(r.doc, "$.maintainers", "struct<name: string>")
    publisher = jstr(v, "$._npmUser.name")
    scripts = F.json_object_keys(F.to_json(F.try_variant_get(v, "$.scripts", "variant")))
    message = F.coalesce(jstr(v, "$.deprecated"), flag(jbool(v, "$.deprecated"), "deprecated"))
    return line | {
        "ecosystem": F.lit("npm"), "name": F.replace(r.name, F.lit("%40"), F.lit("@")), "version": version, "published_at": published, "latest_version": latest,
        "author": F.coalesce(first_present(person, (v, "$.author"), (r.doc, "$.author")), r.s("$.maintainers[0].name")), "deprecated": message,
        **{f: nonempty(first_present(jstr, (v, f"$.{f}"), (r.doc, f"$.{f}"))) for f in ("description", "homepage", "license")}, "repository": first_present(jstr, (v, "$.repository.url"), (r.doc, "$.repository.url")),
        "maintainers": F.coalesce(jlen(r.doc, "$.maintainers"), F.lit(0)), "security_hold": F.coalesce(r.s("$.description") == "security holding package", F.lit(False)),
        "version_removed": v.isNull() & F.coalesce(F.array_contains(F.map_keys(times), version), F.lit(False)), "first_published_at": F.coalesce(rfc3339_seconds(times["created"]), F.array_min(line["release_times"])),
        "publisher": publisher, "publisher_email_domain": email_domain(jstr(v, "$._npmUser.email")), "publisher_in_maintainers": F.when(publisher.isNotNull() & jlen(r.doc, "$.maintainers").isNotNull(), F.coalesce(F.exists(keepers, lambda m: F.coalesce(m["name"] == publisher, F.lit(False))), F.lit(False))),
        "unpacked_size": ju64(v, "$.dist.unpackedSize"), "file_count": ju64(v, "$.dist.fileCount"),
        "has_install_script": F.when(v.isNotNull(), F.coalesce(jbool(v, "$.hasInstallScript"), F.lit(False)) | F.coalesce(F.arrays_overlap(scripts, F.array(F.lit("install"), F.lit("preinstall"), F.lit("postinstall"))), F.lit(False))),
        "downloads_recent": ju64(r.doc2, "$.downloads"),
    }


def crates(r: Row) -> dict:
    latest = first_present(jstr, (r.doc, "$.crate.max_stable_version"), (r.doc, "$.crate.max_version"))
    version = F.coalesce(r.asked, latest, F.lit(""))
    v = r.keep(F.get(F.filter(jparts(r.doc, "$.versions"), lambda x: jstr(x, "$.num") == version), F.lit(0)))
    return {
        "ecosystem": F.lit("crates"), "name": r.name, "version": version, "published_at": rfc3339_seconds(first_present(jstr, (v, "$.created_at"), (r.doc, "$.crate.created_at"))), "latest_version": latest,
        "description": r.s("$.crate.description"), "homepage": r.s("$.crate.homepage"), "repository": r.s("$.crate.repository"), "license": jstr(v, "$.license"),
        "downloads_total": r.u("$.crate.downloads"), "downloads_recent": r.u("$.crate.recent_downloads"), "deprecated": flag(jbool(v, "$.yanked"), "yanked"),
    }


_PYPI_FILE = "struct<upload_time_iso_8601: string, yanked: boolean, yanked_reason: string>"


def pypi(r: Row) -> dict:
    latest = r.s("$.info.version")
    version = F.coalesce(r.asked, latest, F.lit(""))
    releases = F.from_json(F.get_json_object(r.body, "$.releases"), f"map<string, array<{_PYPI_FILE}>>")
    files = r.keep(F.coalesce(releases[version], jlist(r.doc, "$.urls", _PYPI_FILE)))
    first = lambda fs: F.array_min(F.transform(fs, lambda f: rfc3339_seconds(f["upload_time_iso_8601"])))
    published = r.keep(first(files))
    line = timeline(r.keep(F.transform(F.map_values(releases), first)), published, True)
    reason = F.coalesce(F.get(F.array_compact(F.transform(files, lambda f: f["yanked_reason"])), F.lit(0)), F.lit("yanked"))
    roles = jlist(r.doc, "$.ownership.roles", "struct<role: string, user: string>")
    owner = F.coalesce(F.get(F.filter(roles, lambda x: x["role"] == "Owner"), F.lit(0)), F.get(roles, F.lit(0)))
    text = lambda p: F.nullif(r.s(p), F.lit(""))
    return line | {
        "ecosystem": F.lit("pypi"), "name": r.name, "version": version, "published_at": published, "latest_version": latest, "author": F.coalesce(text("$.info.author"), text("$.info.maintainer")),
        "description": r.s("$.info.summary"), "homepage": text("$.info.home_page"), "license": text("$.info.license"), "deprecated": F.when(F.exists(files, lambda f: F.coalesce(f["yanked"], F.lit(False))), reason),
        "vulnerability_count": jlen(r.doc, "$.vulnerabilities"), "first_published_at": F.array_min(line["release_times"]), "publisher": owner["user"],
        "publisher_email_domain": email_domain(F.coalesce(text("$.info.author_email"), r.s("$.info.maintainer_email"))),
    }


def composer(r: Row) -> dict:
    """An unknown version has no release; without one the first that isn't a dev branch counts, in order of name."""
    bare = lambda x: F.regexp_replace(x, "^v+", "")
    versions = F.from_json(F.get_json_object(r.body, "$.package.versions"), "map<string, struct<version: string, time: string, authors: array<struct<name: string>>, license: array<string>>>")
    entries = F.transform(F.array_sort(F.map_keys(versions)), lambda k: F.struct(k.alias("key"), versions[k].alias("value")))
    fits = lambda e: F.when(r.asked.isNotNull(), bare(e["key"]) == bare(r.asked)).otherwise(~e["key"].contains("dev"))
    v = r.keep(F.get(F.filter(entries, fits), F.lit(0)))
    return {
        "ecosystem": F.lit("composer"), "name": r.name, "version": F.coalesce(v["value"]["version"], F.lit("")), "published_at": rfc3339_seconds(v["value"]["time"]), "author": F.get(v["value"]["authors"], F.lit(0))["name"],
        "description": r.s("$.package.description"), "repository": r.s("$.package.repository"), "license": F.get(v["value"]["license"], F.lit(0)), "downloads_total": r.u("$.package.downloads.total"),
        "downloads_recent": r.u("$.package.downloads.monthly"), "rating_count": r.u("$.package.favers"), "maintainers": jlen(r.doc, "$.package.maintainers"),
    }


def gem(r: Row) -> dict:
    version = F.coalesce(r.asked, r.s("$.version"), F.lit(""))
    all_ = jlist(r.doc2, "$", "struct<number: string, created_at: string>")
    v = F.coalesce(F.get(F.filter(all_, lambda x: x["number"] == version), F.lit(0)), F.get(all_, F.lit(0)))
    return {
        "ecosystem": F.lit("gem"), "name": r.name, "version": version, "published_at": rfc3339_seconds(v["created_at"]), "author": r.s("$.authors"), "description": r.s("$.info"), "homepage": r.s("$.homepage_uri"),
        "repository": r.s("$.source_code_uri"), "license": r.s("$.licenses[0]"), "downloads_total": r.u("$.downloads"), "downloads_recent": r.u("$.version_downloads"),
    }


def golang(r: Row) -> dict:
    return {"ecosystem": F.lit("golang"), "name": r.name, "version": F.coalesce(r.s("$.Version"), F.lit("")), "published_at": rfc3339_seconds(r.s("$.Time")), "repository": r.s("$.Origin.URL")}


def github(r: Row) -> dict:
    return {
        "ecosystem": F.lit("github"), "name": r.name, "version": F.lit(""), "published_at": rfc3339_seconds(r.s("$.pushed_at")), "author": r.s("$.owner.login"), "title": r.s("$.full_name"), "description": r.s("$.description"),
        "homepage": F.nullif(r.s("$.homepage"), F.lit("")), "repository": r.s("$.html_url"), "license": F.nullif(r.s("$.license.spdx_id"), F.lit("NOASSERTION")), "rating_count": r.u("$.stargazers_count"), "deprecated": flag(jbool(r.doc, "$.archived"), "archived"),
    }


def aur(r: Row) -> dict:
    p = "$.results[0]"
    return {
        "ecosystem": F.lit("aur"), "name": F.coalesce(r.s(f"{p}.Name"), r.name), "version": F.coalesce(r.s(f"{p}.Version"), F.lit("")), "published_at": r.u(f"{p}.LastModified"), "first_published_at": r.u(f"{p}.FirstSubmitted"),
        "maintainers": F.when(r.s(f"{p}.Maintainer").isNotNull(), 1).otherwise(0) + F.coalesce(jlen(r.doc, f"{p}.CoMaintainers"), F.lit(0)), "author": r.s(f"{p}.Maintainer"), "publisher": r.s(f"{p}.Maintainer"), "title": r.s(f"{p}.Name"),
        "description": r.s(f"{p}.Description"), "homepage": r.s(f"{p}.URL"), "rating": jf64(r.doc, f"{p}.Popularity"), "rating_count": r.u(f"{p}.NumVotes"), "deprecated": flag(r.u(f"{p}.OutOfDate") > 0, "flagged out-of-date"),
    }


def chrome(r: Row) -> dict:
    return {
        "ecosystem": F.lit("chrome"), "name": last_segment(r.name), "version": F.lit(""), "published_at": month_day_year_seconds(text_after(r.body, "Updated")), "author": text_after(r.body, "Offered by"),
        "title": trim(F.regexp_replace(meta_content(r.body, "og:title"), r"( - Chrome Web Store)+\z", "")), "description": meta_content(r.body, "og:description"), "homepage": F.concat(F.lit("https://chromewebstore.google.com/detail/"), last_segment(r.name)),
        "downloads_total": grouped_number(number_before(r.body, " users")), "rating": number_before(r.body, " out of 5 stars").try_cast("float"), "rating_count": grouped_number(number_before(r.body, " ratings")),
    }


def openvsx(r: Row) -> dict:
    return {
        "ecosystem": F.lit("openvsx"), "name": F.concat_ws(".", *halves(r.name)), "version": F.coalesce(r.s("$.version"), F.lit("")), "published_at": rfc3339_seconds(r.s("$.timestamp")), "author": r.s("$.publishedBy.loginName"),
        "publisher": r.s("$.publishedBy.loginName"), "release_count": jlen(r.doc, "$.allVersions", "OBJECT"), "publisher_verified": lower_ascii(r.s("$.namespaceAccess")) == "restricted", "title": r.s("$.displayName"),
        "description": r.s("$.description"), "homepage": r.s("$.homepage"), "repository": r.s("$.repository"), "license": r.s("$.license"), "downloads_total": r.u("$.downloadCount"), "rating": jf64(r.doc, "$.averageRating"),
        "rating_count": r.u("$.reviewCount"), "deprecated": flag(jbool(r.doc, "$.deprecated"), "deprecated"),
    }


def vscode(r: Row) -> dict:
    p = "$.results[0].extensions[0]"
    versions = jlist(r.doc, f"{p}.versions", "struct<version: string, lastUpdated: string>")
    published = r.keep(rfc3339_seconds(r.s(f"{p}.lastUpdated")))
    told = r.keep(jlist(r.doc, f"{p}.statistics", "struct<statisticName: string, value: double>"))
    stat = lambda name: F.get(F.filter(told, lambda x: x["statisticName"] == name), F.lit(0))["value"]
    whole = lambda x: F.greatest(x, F.lit(0.0)).cast("bigint")
    return timeline(r.keep(F.transform(versions, lambda v: rfc3339_seconds(v["lastUpdated"]))), published) | {
        "ecosystem": F.lit("vscode"), "name": F.replace(r.name, F.lit("/"), F.lit(".")), "version": F.coalesce(F.get(versions, F.lit(0))["version"], F.lit("")), "published_at": published, "first_published_at": rfc3339_seconds(r.s(f"{p}.publishedDate")),
        "author": r.s(f"{p}.publisher.displayName"), "publisher": r.s(f"{p}.publisher.publisherName"), "publisher_verified": jbool(r.doc, f"{p}.publisher.isDomainVerified"), "title": r.s(f"{p}.displayName"), "description": r.s(f"{p}.shortDescription"),
        "downloads_total": F.when(stat("install").isNotNull(), whole(stat("install"))), "rating": stat("averagerating"), "rating_count": F.when(stat("ratingcount").isNotNull(), whole(stat("ratingcount"))),
    }


_NUGET = "struct<items: array<struct<catalogEntry: struct<version: string, published: string, listed: boolean, licenseExpression: string, deprecation: struct<message: string>>>>>"


def nuget(r: Row) -> dict:
    """``body`` is the search answer, ``body2`` the registration with its pages inline, ``body3`` the package's XML."""
    data = "$.data[0]"
    latest = r.s(f"{data}.version")
    listed = jlist(r.doc, f"{data}.versions", "struct<version: string>")
    version = F.when(F.exists(listed, lambda v: v["version"] == r.asked), r.asked).otherwise(F.coalesce(latest, F.lit("")))
    pages = jlist(r.doc2, "$.items", _NUGET)
    entries = r.keep(F.transform(F.flatten(F.transform(pages, lambda p: p["items"])), lambda i: i["catalogEntry"]))
    e = F.get(F.filter(entries, lambda x: x["version"] == version), F.lit(0))
    published = r.keep(rfc3339_seconds(e["published"]))
    line = timeline(r.keep(F.transform(entries, lambda x: rfc3339_seconds(x["published"]))), published)
    reason = lambda x: F.when(x.isNotNull(), F.coalesce(x["message"], F.lit("deprecated")))
    told = F.schema_of_variant(F.try_variant_get(r.doc, f"{data}.deprecation", "variant"))
    said = F.when(told != "VOID", F.coalesce(r.s(f"{data}.deprecation.message"), F.lit("deprecated")))
    manifest = r.keep(sound_xml(r.body3))
    last = lambda path: nonempty(F.xpath_string(manifest, F.lit(path)))
    return line | {
        "ecosystem": F.lit("nuget"), "name": F.coalesce(r.s(f"{data}.id"), r.name), "version": version, "latest_version": latest, "published_at": published, "first_published_at": F.array_min(line["release_times"]),
        "author": F.coalesce(r.s(f"{data}.authors[0]"), r.s(f"{data}.authors")), "description": r.s(f"{data}.description"), "homepage": F.nullif(r.s(f"{data}.projectUrl"), F.lit("")), "downloads_total": r.u(f"{data}.totalDownloads"), "maintainers": jlen(r.doc, f"{data}.owners"),
        "vulnerability_count": jlen(r.doc, f"{data}.vulnerabilities"), "version_removed": ~e["listed"], "license": F.coalesce(nonempty(trim(last("(//*[local-name()='license'][@type='expression'][normalize-space(text())])[last()]/text()"))), nonempty(e["licenseExpression"])),
        "deprecated": F.coalesce(said, reason(e["deprecation"])),
        **{f: last(f"(//*[local-name()='repository'][string(@{a})])[last()]/@{a}") for f, a in (("repository", "url"), ("repository_commit", "commit"))},
    }


def maven(r: Row) -> dict:
    doc = "$.response.docs[0]"
    return {"ecosystem": F.lit("maven"), "name": F.concat_ws(":", *halves(r.name)), "version": F.coalesce(r.s(f"{doc}.v"), F.lit("")), "published_at": F.floor(r.u(f"{doc}.timestamp") / 1000), "latest_version": F.when(r.asked.isNull(), r.s(f"{doc}.v"))}


def texts(map_: Column) -> Column:
    """The values of a map that are texts, in order of their keys."""
    return F.array_compact(F.transform(F.array_sort(F.map_keys(map_)), lambda k: jstr(map_[k], "$")))


def links_repository(r: Row, path: str) -> Column:
    """The link under the first known key, else the first in order of name."""
    links = r.keep(jmap(r.doc, path))
    return F.coalesce(*[jstr(links[k], "$") for k in ("GitHub", "Github", "github", "GitLab", "Repository", "Source")], F.get(texts(links), F.lit(0)))


def hex_pm(r: Row) -> dict:
    latest = first_present(jstr, (r.doc, "$.latest_stable_version"), (r.doc, "$.latest_version"))
    version = F.coalesce(r.asked, latest, F.lit(""))
    releases = jlist(r.doc, "$.releases", "struct<version: string, inserted_at: string>")
    v = F.coalesce(F.get(F.filter(releases, lambda x: x["version"] == version), F.lit(0)), F.get(releases, F.lit(0)))
    return {
        "ecosystem": F.lit("hex"), "name": r.name, "version": version, "published_at": F.coalesce(timestamp_seconds(v["inserted_at"]), timestamp_seconds(r.s("$.inserted_at"))), "latest_version": latest, "description": r.s("$.meta.description"),
        "license": r.s("$.meta.licenses[0]"), "repository": links_repository(r, "$.meta.links"), "downloads_total": r.u("$.downloads.all"), "downloads_recent": r.u("$.downloads.recent"),
    }


def cran(r: Row) -> dict:
    return {
        "ecosystem": F.lit("cran"), "name": F.coalesce(r.s("$.Package"), r.name), "version": F.coalesce(r.s("$.Version"), F.lit("")), "published_at": timestamp_seconds(r.s("$['Date/Publication']")), "author": strip_email(r.s("$.Maintainer")),
        "description": r.s("$.Title"), "homepage": first_line(r.s("$.URL")), "license": r.s("$.License"),
    }


def cpan(r: Row) -> dict:
    return {
        "ecosystem": F.lit("cpan"), "name": F.coalesce(r.s("$.distribution"), r.name), "version": F.coalesce(r.s("$.version"), F.lit("")), "published_at": timestamp_seconds(r.s("$.date")), "author": r.s("$.author"), "description": r.s("$.abstract"),
        "homepage": r.s("$.resources.homepage"), "repository": r.s("$.resources.repository.url"), "license": r.s("$.license[0]"), "deprecated": flag(r.s("$.status") == "backpan", "removed from CPAN"),
    }


def pub_dev(r: Row) -> dict:
    versions = jlist(r.doc, "$.versions", "struct<version: string, published: string, pubspec: struct<description: string, homepage: string, repository: string>>")
    latest = r.s("$.latest.version")
    v = F.get(F.filter(versions, lambda x: x["version"] == F.coalesce(r.asked, latest)), F.lit(0))
    known = v.isNotNull()
    pick = lambda f: F.when(known, v["pubspec"][f]).otherwise(r.s(f"$.latest.pubspec.{f}"))
    return {
        "ecosystem": F.lit("pub"), "name": r.name, "version": F.coalesce(F.when(known, v["version"]).otherwise(latest), F.lit("")), "published_at": timestamp_seconds(F.when(known, v["published"]).otherwise(r.s("$.latest.published"))), "latest_version": latest,
        "description": pick("description"), "homepage": pick("homepage"), "repository": pick("repository"),
    }


def conda(r: Row) -> dict:
    latest = r.s("$.latest_version")
    version = F.coalesce(r.asked, latest, F.lit(""))
    files = jlist(r.doc, "$.files", "struct<version: string, upload_time: string, ndownloads: bigint>")
    own = F.array_min(F.transform(F.filter(files, lambda f: f["version"] == version), lambda f: timestamp_seconds(f["upload_time"])))
    return {
        "ecosystem": F.lit("conda"), "name": r.name, "version": version, "published_at": F.coalesce(own, timestamp_seconds(r.s("$.created_at"))), "latest_version": latest, "description": r.s("$.summary"), "homepage": r.s("$.home"),
        "repository": F.coalesce(r.s("$.source_git_url"), r.s("$.dev_url")), "license": r.s("$.license"), "downloads_total": r.u("$.ndownloads"),
    }


def clojars(r: Row) -> dict:
    group, artifact = r.s("$.group_name"), r.s("$.jar_name")
    return {
        "ecosystem": F.lit("clojars"), "name": F.coalesce(F.when(group != artifact, F.concat(group, F.lit("/"), artifact)), artifact, r.name), "version": F.coalesce(first_present(jstr, (r.doc, "$.latest_release"), (r.doc, "$.latest_version")), F.lit("")),
        "latest_version": r.s("$.latest_version"), "description": r.s("$.description"), "homepage": r.s("$.homepage"), "repository": r.s("$.scm.url"), "license": r.s("$.licenses[0].name"), "downloads_total": r.u("$.downloads"),
    }


def jsr(r: Row) -> dict:
    latest = r.s("$.latestVersion")
    version = F.coalesce(r.asked, latest, F.lit(""))
    all_ = jlist(r.doc2, "$", "struct<version: string, createdAt: string>")
    v = F.coalesce(F.get(F.filter(all_, lambda x: x["version"] == version), F.lit(0)), F.get(all_, F.lit(0)))
    return {
        "ecosystem": F.lit("jsr"), "name": F.concat(F.lit("@"), F.regexp_replace(F.replace(r.name, F.lit("%40"), F.lit("@")), "^@+", "")), "version": version, "published_at": timestamp_seconds(v["createdAt"]), "latest_version": latest, "description": r.s("$.description"),
        "repository": F.concat(F.lit("https://github.com/"), r.s("$.githubRepository.owner"), F.lit("/"), r.s("$.githubRepository.name")), "rating": jf64(r.doc, "$.score"),
    }


def arch(r: Row) -> dict:
    p = "$.results[0]"
    return {
        "ecosystem": F.lit("arch"), "name": F.coalesce(r.s(f"{p}.pkgname"), r.name), "version": release(r.s(f"{p}.pkgver"), r.s(f"{p}.pkgrel")), "published_at": timestamp_seconds(F.coalesce(r.s(f"{p}.last_update"), r.s(f"{p}.build_date"))),
        "author": r.s(f"{p}.packager"), "description": r.s(f"{p}.pkgdesc"), "homepage": r.s(f"{p}.url"), "license": r.s(f"{p}.licenses[0]"), "maintainers": jlen(r.doc, f"{p}.maintainers"), "deprecated": flag(r.s(f"{p}.flag_date").isNotNull(), "flagged out-of-date"),
    }


def fedora(r: Row) -> dict:
    return {
        "ecosystem": F.lit("fedora"), "name": F.coalesce(r.s("$.basename"), r.name), "version": release(r.s("$.version"), r.s("$.release")), "description": F.coalesce(r.s("$.summary"), r.s("$.description")), "homepage": r.s("$.url"), "license": nonempty(r.s("$.license")),
    }


def clawhub(r: Row) -> dict:
    p = "$.skill"
    seconds = lambda path: F.floor(F.floor(jf64(r.doc, path)) / 1000)
    return {
        "ecosystem": F.lit("clawhub"), "name": r.name, "version": F.coalesce(r.s(f"{p}.tags.latest"), F.lit("")), "published_at": seconds(f"{p}.updatedAt"), "first_published_at": seconds(f"{p}.createdAt"), "title": r.s(f"{p}.displayName"),
        "description": r.s(f"{p}.summary"), "downloads_total": r.u(f"{p}.stats.downloads"), "rating_count": r.u(f"{p}.stats.stars"), "release_count": r.u(f"{p}.stats.versions"),
    }


def oci(r: Row) -> dict:
    """Docker Hub and Quay answers in one: their fields don't clash."""
    return {
        "ecosystem": F.lit("oci"), "name": F.coalesce(r.s("$.name"), last_segment(r.name)), "version": F.lit(""), "published_at": F.coalesce(timestamp_seconds(r.s("$.last_updated")), r.u("$.last_modified")), "first_published_at": timestamp_seconds(r.s("$.date_registered")),
        "author": first_present(jstr, (r.doc, "$.namespace"), (r.doc, "$.user")), "description": nonempty(r.s("$.description")), "downloads_total": r.u("$.pull_count"), "rating_count": F.coalesce(r.u("$.star_count"), r.u("$.popularity")),
    }


def homebrew(r: Row) -> dict:
    installs = F.array_compact(F.transform(F.map_values(jmap(r.doc, "$.analytics.install['30d']")), lambda x: ju64(x, "$")))
    return {
        "ecosystem": F.lit("homebrew"), "name": F.coalesce(r.s("$.name"), r.name), "version": F.coalesce(r.s("$.versions.stable"), F.lit("")), "description": r.s("$.desc"), "homepage": r.s("$.homepage"), "license": r.s("$.license"),
        "downloads_recent": F.aggregate(installs, F.lit(0).cast("bigint"), lambda a, x: a + x), "deprecated": F.coalesce(flag(jbool(r.doc, "$.deprecated"), "deprecated"), flag(jbool(r.doc, "$.disabled"), "disabled")),
    }


def snap(r: Row) -> dict:
    channels = jlist(r.doc, "$['channel-map']", "struct<version: string, channel: struct<name: string, track: string, risk: string, `released-at`: string>>")
    stable = F.get(F.filter(channels, lambda c: (c["channel"]["track"] == "latest") & (c["channel"]["risk"] == "stable")), F.lit(0))
    c = F.coalesce(stable, F.get(channels, F.lit(0)))
    p = "$.snap"
    return {
        "ecosystem": F.lit("snap"), "name": r.name, "version": F.coalesce(c["version"], F.lit("")), "published_at": timestamp_seconds(c["channel"]["released-at"]), "author": r.s(f"{p}.publisher['display-name']"), "title": r.s(f"{p}.title"),
        "description": F.coalesce(r.s(f"{p}.summary"), r.s(f"{p}.description")), "homepage": F.coalesce(nonempty(r.s(f"{p}.website")), r.s(f"{p}['store-url']")), "license": nonempty(r.s(f"{p}.license")),
    }


def wordpress(r: Row) -> dict:
    return {
        "ecosystem": F.lit("wordpress"), "name": F.coalesce(r.s("$.slug"), r.name), "version": F.coalesce(r.s("$.version"), F.lit("")), "published_at": ymd_seconds(r.s("$.last_updated")), "author": strip_html(r.s("$.author")), "title": r.s("$.name"),
        "homepage": nonempty(r.s("$.homepage")), "downloads_total": r.u("$.downloaded"), "rating": jf64(r.doc, "$.rating") / 20, "rating_count": r.u("$.num_ratings"),
    }


def huggingface(r: Row) -> dict:
    tag = F.get(F.filter(jlist(r.doc, "$.tags", "string"), lambda t: t.startswith("license:")), F.lit(0))
    return {
        "ecosystem": F.lit("huggingface"), "name": F.coalesce(r.s("$.id"), r.name), "version": F.coalesce(r.asked, r.s("$.sha"), F.lit("")), "published_at": timestamp_seconds(r.s("$.lastModified")), "first_published_at": timestamp_seconds(r.s("$.createdAt")),
        "author": r.s("$.author"), "homepage": F.concat(F.lit("https://huggingface.co/"), F.coalesce(r.s("$.id"), r.name)), "license": F.coalesce(r.s("$.license"), r.s("$.cardData.license"), F.substr(tag, F.lit(len("license:") + 1))),
        "downloads_recent": r.u("$.downloads"), "rating_count": r.u("$.likes"),
    }


def localized(doc, path: str) -> Column:
    """A text, or a map of languages with en-US before the first other."""
    words = jmap(doc, path)
    return F.coalesce(nonempty(jstr(doc, path)), nonempty(jstr(words["en-US"], "$")), F.get(F.filter(texts(words), lambda x: x != ""), F.lit(0)))


def firefox(r: Row) -> dict:
    current = F.coalesce(r.s("$.current_version.reviewed"), r.s("$.last_updated"))
    published = r.keep(timestamp_seconds(current))
    releases = r.keep(jparts(r.doc2, "$.results"))
    of = lambda x: timestamp_seconds(first_present(jstr, (x, "$.reviewed"), (x, "$.created")))
    return timeline(r.keep(F.transform(releases, of)), published) | {
        "ecosystem": F.lit("firefox"), "name": F.coalesce(r.s("$.slug"), r.name), "version": F.coalesce(r.s("$.current_version.version"), F.lit("")), "published_at": published, "first_published_at": timestamp_seconds(r.s("$.created")),
        "author": r.s("$.authors[0].name"), "maintainers": jlen(r.doc, "$.authors"), "title": localized(r.doc, "$.name"), "description": localized(r.doc, "$.summary"), "homepage": localized(r.doc, "$.homepage.url"),
        "license": localized(r.doc, "$.current_version.license.name"), "downloads_total": r.u("$.average_daily_users"), "downloads_recent": r.u("$.weekly_downloads"), "rating": jf64(r.doc, "$.ratings.average"), "rating_count": r.u("$.ratings.count"),
        "deprecated": flag(jbool(r.doc, "$.is_disabled"), "disabled"),
    }


def jetbrains(r: Row) -> dict:
    """``body`` is the plugin, ``body2`` its newest update (the search that finds its number is a join before)."""
    return {
        "ecosystem": F.lit("jetbrains"), "name": F.coalesce(r.s("$.xmlId"), r.name), "version": F.coalesce(jstr(r.doc2, "$[0].version"), F.lit("")), "published_at": millis_seconds(F.coalesce(jstr(r.doc2, "$[0].cdate"), ju64(r.doc2, "$[0].cdate").cast("string"))),
        "author": F.coalesce(r.s("$.vendor"), r.s("$.vendor.name")), "title": r.s("$.name"), "description": r.s("$.preview"), "homepage": nonempty(r.s("$.urls.url")), "repository": nonempty(r.s("$.urls.sourceCodeUrl")), "downloads_total": r.u("$.downloads"), "rating": jf64(r.doc, "$.rating"),
    }


def _positive(text: Column) -> Column:
    n = F.when(text.rlike(r"^\+?[0-9]+\z"), text.try_cast("bigint"))
    return F.when(n > 0, n)


def apk(ecosystem: str) -> Callable:
    def of(r: Row) -> dict:
        f = lambda k: stanza_field(r.body, k)
        return {"ecosystem": F.lit(ecosystem), "name": r.name, "version": F.coalesce(f("V:"), F.lit("")), "published_at": _positive(f("t:")), "author": strip_email(f("m:")), "description": f("T:"), "homepage": f("U:"), "license": f("L:")}

    return of


def deb(ecosystem: str) -> Callable:
    def of(r: Row) -> dict:
        f = lambda k: stanza_field(r.body, k)
        return {"ecosystem": F.lit(ecosystem), "name": r.name, "version": F.coalesce(f("Version:"), F.lit("")), "author": strip_email(f("Maintainer:")), "description": f("Description:"), "homepage": f("Homepage:")}

    return of


def rpm(ecosystem: str) -> Callable:
    def of(r: Row) -> dict:
        version = release(tag_attribute(r.body, "version", "ver"), tag_attribute(r.body, "version", "rel"))
        return {
            "ecosystem": F.lit(ecosystem), "name": r.name, "version": version, "published_at": _positive(tag_attribute(r.body, "time", "build")), "author": F.coalesce(tag_text(r.body, "rpm:vendor"), tag_text(r.body, "packager")),
            "description": tag_text(r.body, "summary"), "homepage": tag_text(r.body, "url"), "license": tag_text(r.body, "rpm:license"),
        }

    return of


def netbsd(r: Row) -> dict:
    f = lambda k: stanza_field(r.body, k + "=")
    return {
        "ecosystem": F.lit("netbsd"), "name": r.name, "version": F.substr(f("PKGNAME"), F.length(r.name) + 2), "published_at": timestamp_seconds(f("BUILD_DATE")), "author": strip_email(f("MAINTAINER")), "description": f("COMMENT"),
        "homepage": f("HOMEPAGE"), "license": f("LICENSE"),
    }


def freebsd(r: Row) -> dict:
    return {"ecosystem": F.lit("freebsd"), "name": r.name, "version": F.coalesce(r.s("$.version"), F.lit("")), "author": strip_email(r.s("$.maintainer")), "description": r.s("$.comment"), "homepage": r.s("$.www"), "license": r.s("$.licenses[0]")}


def listed_version(file, name: Column) -> Column:
    """What follows ``name-`` in an archive's file name, where it begins with a digit."""
    tail = F.when(F.startswith(F.col(file) if isinstance(file, str) else file, F.concat(name, F.lit("-"))), F.substr(file, F.length(name) + 2))
    return group_of(tail, r"(?s)^([0-9].*)\.tgz\z")


def openbsd(r: Row) -> dict:
    """``body`` is a listing, or one file name of it: the first that is the asked name and a version counts."""
    files = F.transform(F.split(r.body, f"[{BLANK}]+"), lambda t: listed_version(F.substring_index(t, "/", -1), r.name))
    return {"ecosystem": F.lit("openbsd"), "name": r.name, "version": F.get(F.array_compact(files), F.lit(0))}


NORMALIZERS: dict[str, Callable[[Row], dict]] = {
    "npm": npm, "cargo": crates, "pypi": pypi, "composer": composer, "gem": gem, "golang": golang, "github": github, "aur": aur, "chrome": chrome, "openvsx": openvsx, "vscode": vscode, "nuget": nuget, "maven": maven,
    "hex": hex_pm, "cran": cran, "cpan": cpan, "pub": pub_dev, "conda": conda, "clojars": clojars, "jsr": jsr, "arch": arch, "fedora": fedora, "clawhub": clawhub, "oci": oci, "homebrew": homebrew, "snap": snap,
    "wordpress": wordpress, "huggingface": huggingface, "firefox": firefox, "jetbrains": jetbrains, "alpine": apk("alpine"), "wolfi": apk("wolfi"), "debian": deb("debian"), "ubuntu": deb("ubuntu"),
    "opensuse": rpm("opensuse"), "rpmfusion": rpm("rpmfusion"), "netbsd": netbsd, "freebsd": freebsd, "openbsd": openbsd,
}


#: What a document must hold to give a record at all, be it null.
REQUIRED = {
    "cargo": "$.crate", "pypi": "$.info", "composer": "$.package", "aur": "$.results[0]", "vscode": "$.results[0].extensions[0]", "nuget": "$.data[0]", "maven": "$.response.docs[0]", "arch": "$.results[0]",
    "clawhub": "$.skill", "snap": "$.snap",
}


def concerns(kind: str) -> Column | None:
    """Whether a document is the asked package's own; null where every answer is."""
    name, body = F.col("name"), F.col("body")
    if kind in ("alpine", "wolfi"):
        return stanza_field(body, "P:") == name
    if kind in ("debian", "ubuntu"):
        return stanza_field(body, "Package:") == name
    if kind in ("opensuse", "rpmfusion"):
        return tag_text(body, "name") == name
    if kind == "netbsd":
        return F.startswith(stanza_field(body, "PKGNAME="), F.concat(name, F.lit("-")))
    if kind == "freebsd":
        return jstr(F.col("__doc"), "$.name") == name
    if kind in ("maven", "openvsx", "jsr"):  # names of two parts
        return F.contains(name, F.lit("/"))
    return None


def inline_pages(docs: DataFrame, pages: DataFrame, key: list[str], body: str = "body2") -> DataFrame:
    """``docs`` with the pages that a registration index only names put in from ``pages(url, content)``.

    An index lists pages that hold their items or an ``@id``; the named ones meet ``pages`` in one left
    join, pages that aren't there stay empty. Rows are told apart by ``key``.
    """
    page = "struct<items: array<struct<`@id`: string, items: string>>>"
    listed = docs.select(*key, F.posexplode(F.from_json(body, page)["items"]).alias("pos", "page"))
    met = meet(listed, pages.select(F.col("url").alias("__url"), F.get_json_object("content", "$.items").alias("__items")), F.col("page.items").isNull() & (F.col("page.`@id`") == F.col("__url")), "left")
    one = F.concat(F.lit('{"items":'), F.coalesce(F.col("page.items"), F.col("__items"), F.lit("[]")), F.lit("}"))
    whole = met.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("text")))).alias("__pages"))
    made = F.concat(F.lit('{"items":['), F.array_join(F.transform("__pages", lambda p: p["text"]), ","), F.lit("]}"))
    return meet(docs.drop(body), whole.select(*key, made.alias(body)), key, "left")


def normalize(docs: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of one ecosystem from ``docs(name, version, body[, body2, body3])``; rows without a usable body drop out.

    Columns named in ``keep`` stand before the record. Documents of another package (a stanza, element or
    line of another name) give none.
    """
    for extra in ("body2", "body3"):
        if extra not in docs.columns:
            docs = docs.withColumn(extra, F.lit(None).cast("string"))
    reader = Row()
    made = NORMALIZERS[kind](reader)
    rows = docs.where("body IS NOT NULL").withColumns({"__doc": F.try_parse_json("body"), "__doc2": F.try_parse_json("body2")})  # parsed once, read by every field
    if kind not in ("chrome", "alpine", "wolfi", "debian", "ubuntu", "opensuse", "rpmfusion", "netbsd", "openbsd"):
        rows = rows.where("__doc IS NOT NULL")
    if kind in REQUIRED:
        rows = rows.where(present(F.col("__doc"), REQUIRED[kind]))
    own = concerns(kind)
    if own is not None:
        rows = rows.where(own)
    rows = rows.select("*", *[value.alias(name) for name, value in reader.kept])  # a later one may read an earlier one
    if kind == "openbsd":
        rows = rows.where(made["version"].isNotNull())
    return rows.select(*keep, *[(made[f].cast(t) if f in made else F.lit(None).cast(t)).alias(f) for f, t in FIELDS.items()])


def with_sources(asked: DataFrame, served: DataFrame, kind: str, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Records of ``asked(*key, name, version, urls)`` and the raw documents behind them, both under ``key``.

    ``urls`` lists one to three documents in the order they are read; what ``served`` holds for them
    becomes ``body``, ``body2`` and ``body3``. A key whose first document is missing has no record, but
    its other documents are still told.
    """
    sources = recorded(asked, served, list(key))
    at = lambda n: F.max(F.when(F.col("pos") == n, F.col("content").cast("string")))
    bodies = sources.groupBy(*key).agg(at(0).alias("body"), at(1).alias("body2"), at(2).alias("body3"))
    return normalize(meet(asked.select(*key, "name", "version"), bodies, list(key)), kind, key), sources


def with_age(records: DataFrame, now: int) -> DataFrame:
    """Days since publication at the clock given by the caller."""
    return records.withColumn("age_days", F.when(F.col("published_at") <= now, F.floor((F.lit(now) - F.col("published_at")) / 86400).cast("bigint")))


#: The normalizer of each package-URL type that has another name.
ALIASES = {"docker": "oci", "chrome-extension": "chrome"}


def dispatch(kind, path, purl) -> Column:
    """Which normalizer serves a package URL; null if none does. Distribution types without a known vendor go to their first one."""
    vendor = F.substring_index(path, "/", 1)
    plain = [k for k in NORMALIZERS if k not in ("vscode",)]
    return (
        F.when(kind.isin(*plain, "vscode"), kind)
        .when(kind.isin(*ALIASES), F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[kind])
        .when(kind == "vscode-extension", F.when(purl.contains("open-vsx.org"), "openvsx").otherwise("vscode"))
        .when(kind == "alpm", F.when((vendor == "aur") & path.contains("/") | purl.contains("aur.archlinux.org"), "aur").otherwise("arch"))
        .when(kind == "deb", F.when(vendor.isin("ubuntu") & path.contains("/"), vendor).otherwise("debian"))
        .when(kind == "rpm", F.when(vendor.isin("opensuse", "rpmfusion") & path.contains("/"), vendor).otherwise("fedora"))
        .when(kind == "apk", F.when(vendor.isin("wolfi") & path.contains("/"), vendor).otherwise("alpine"))
    )


def release_timeline(events: DataFrame, package: str, time: str) -> DataFrame:
    """Timeline features of every release: count, first, and the previous release strictly before.

    One shuffle by package; the strict as-of is a range frame that ends one second before.
    """
    from pyspark.sql.window import Window

    whole = Window.partitionBy(package)
    before = whole.orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    return events.withColumns({"release_count": F.count(time).over(whole), "first_published_at": F.min(time).over(whole), "previous_published_at": F.max(time).over(before)})
