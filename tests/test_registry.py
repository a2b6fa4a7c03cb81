import json

import pytest

from tessera.operators import registry as R


def one(spark, kind, body, version=None, name="n", body2=None, body3=None):
    text = lambda b: b if b is None or isinstance(b, str) else json.dumps(b)
    df = spark.createDataFrame([(name, version, text(body), text(body2), text(body3))], "name string, version string, body string, body2 string, body3 string")
    rows = R.normalize(df, kind).collect()
    return rows[0] if rows else None


@pytest.mark.parametrize("kind", sorted(R.NORMALIZERS))
def test_empty_documents_give_unknowns(spark, kind):
    row = one(spark, kind, "{}")
    if kind in R.REQUIRED or kind == "openbsd" or R.concerns(kind) is not None:
        assert row is None
        return
    assert row.ecosystem and row.published_at is None and row.rating is None
    assert set(row.asDict()) == set(R.FIELDS)


def test_pypi_timeline_and_yank(spark):
    day = "2024-01-0{}T00:00:00Z"
    body = {"info": {"version": "2", "author": "", "maintainer": "M", "author_email": "a <x@Y.org>"}, "ownership": {"roles": [{"role": "M", "user": "u1"}, {"role": "Owner", "user": "u2"}]}, "vulnerabilities": [1],
            "releases": {"1": [{"upload_time_iso_8601": day.format(1)}], "2": [{"upload_time_iso_8601": day.format(3), "yanked": True, "yanked_reason": "bad"}, {"upload_time_iso_8601": day.format(2)}], "3": []}}
    row = one(spark, "pypi", body)
    base = 1704067200
    assert (row.published_at, row.previous_published_at, row.first_published_at, row.release_count) == (base + 86400, base, base, 2)
    assert (row.deprecated, row.author, row.publisher, row.publisher_email_domain, row.vulnerability_count) == ("bad", "M", "u2", "y.org", 1)


def test_nuget_composes_three_documents(spark):
    entry = lambda v, d, **k: {"catalogEntry": {"version": v, "published": f"2024-01-0{d}T00:00:00.5+00:00", **k}}
    row = one(spark, "nuget", {"data": [{"id": "Json", "version": "2.0", "versions": [{"version": "1.0"}, {"version": "2.0"}], "authors": ["A"]}]}, "1.0", body2={"items": [{"items": [entry("1.0", 2, listed=False), entry("2.0", 5)]}]}, body3='<package><metadata><license type="expression">MIT</license><repository type="git" url="https://g/x" commit="abc"/></metadata></package>')
    assert (row.name, row.version, row.latest_version, row.version_removed, row.license, row.repository, row.repository_commit, row.release_count) == ("Json", "1.0", "2.0", True, "MIT", "https://g/x", "abc", 2)


def test_strict_types_and_fallbacks(spark):
    row = one(spark, "github", {"pushed_at": 5, "stargazers_count": "7", "archived": "yes", "license": {"spdx_id": "NOASSERTION"}})
    assert row.published_at is None and row.rating_count is None and row.deprecated is None and row.license is None
    row = one(spark, "hex", {"releases": [{"version": "1", "inserted_at": "2024-01-01T00:00:00Z"}], "latest_version": "1"}, "9")
    assert row.version == "9" and row.published_at == 1704067200
    row = one(spark, "alpine", "C:x\nP:n\nV:1.2-r0\nt:1700000000\nm:A B <a@b.c>\nL:MIT")
    assert (row.version, row.published_at, row.author, row.license) == ("1.2-r0", 1700000000, "A B", "MIT")


def test_nulls_and_unknown_versions(spark):
    assert one(spark, "cargo", {"crate": {"max_stable_version": None, "max_version": "2.0-rc"}}).version == ""
    assert one(spark, "cargo", {"crate": {"max_version": "2.0-rc"}}).version == "2.0-rc"
    assert one(spark, "hex", {"latest_stable_version": None, "latest_version": "2"}).latest_version is None
    body = {"package": {"versions": {"dev-main": {"version": "dev-main"}, "v1.0": {"version": "v1.0", "time": "2024-01-01T00:00:00+00:00"}}}}
    row = one(spark, "composer", body, "9.9")
    assert row.version == "" and row.published_at is None
    assert one(spark, "composer", body).version == one(spark, "composer", body, "1.0").version == "v1.0"
    row = one(spark, "nuget", {"data": [{"version": "2.0", "versions": [{"version": "1.0-Beta"}]}]}, "1.0-beta")
    assert row.version == "2.0"


def test_nuget_pages_by_reference(spark):
    entry = lambda v, d: {"catalogEntry": {"version": v, "published": f"2024-01-0{d}T00:00:00Z"}}
    index = {"items": [{"@id": "u1"}, {"@id": "u2", "items": [entry("2.0", 5)]}, {"@id": "gone"}]}
    docs = spark.createDataFrame([("n", "1.0", json.dumps({"data": [{"version": "2.0", "versions": [{"version": "1.0"}]}]}), json.dumps(index))], "name string, version string, body string, body2 string")
    pages = spark.createDataFrame([("u1", json.dumps({"items": [entry("1.0", 2)]}))], "url string, content string")
    row = R.normalize(R.inline_pages(docs, pages, ["name", "version"]), "nuget").first()
    assert (row.version, row.release_count, row.published_at, row.first_published_at) == ("1.0", 2, 1704153600, 1704153600)
