from tessera.functions import purl as P

NORMAL = [
    ("pkg:npm/lodash@4.17.21", "pkg:npm/lodash@4.17.21"),
    ("PKG:NPM/@scope/Name@1.0", "pkg:npm/%40scope/Name@1.0"),
    ("pkg:npm/%40s/n?a=1@2.0", "pkg:npm/%40s/n@2.0?a=1"),
    ("pkg:pypi/My_Pkg..X@1", "pkg:pypi/my-pkg-x@1"),
    ("pkg:composer/Vendor/Name", "pkg:composer/vendor/name"),
    ("pkg:debian/CURL@7?arch=amd64", "pkg:deb/debian/curl@7?arch=amd64"),
    ("pkg:fedora/GCC", "pkg:rpm/fedora/GCC"),
    ("pkg:deb/curl?distro=debian-12", "pkg:deb/debian/curl?distro=debian-12"),
    ("pkg:deb/curl?distro=jammy", "pkg:deb/curl?distro=jammy"),
    ("pkg:rpm/Fedora/GCC", "pkg:rpm/fedora/GCC"),
    ("pkg:alpm/x/Yay?repository_url=https://aur.archlinux.org&a=1", "pkg:alpm/aur/yay?a=1"),
    ("pkg:arch/Yay?repository_url=https://aur.archlinux.org", "pkg:alpm/aur/yay"),
    ("pkg:alpm/aur/Yay", "pkg:alpm/aur/yay"),
    ("pkg:chrome/a/ABC@1", "pkg:chrome-extension/abc@1"),
    ("pkg:openvsx/Red/Java@1", "pkg:vscode-extension/red/java@1?repository_url=https://open-vsx.org"),
    ("pkg:openvsx/r/j?repository_url=x", "pkg:vscode-extension/r/j?repository_url=x"),
    ("pkg:npm/@1.0", None),
    ("pkg:npm/", None),
    ("npm/x", None),
    ("", None),
    (None, None),
]
URLS = [
    ("https://registry.npmjs.org/@s/n/-/n-1.2.tgz", "pkg:npm/%40s/n@1.2"),
    ("https://static.crates.io/crates/serde/serde-1.0.crate", "pkg:cargo/serde@1.0"),
    ("https://crates.io/api/v1/crates/serde/1.0/download", "pkg:cargo/serde@1.0"),
    ("https://files.pythonhosted.org/packages/a/b/My_Pkg-1.0-py3-none-any.whl", "pkg:pypi/my-pkg@1.0"),
    ("https://files.pythonhosted.org/packages/x/foo-bar-2.1.tar.gz#sha", "pkg:pypi/foo-bar@2.1"),
    ("https://rubygems.org/downloads/rails-7.0.gem", "pkg:gem/rails@7.0"),
    ("https://rubygems.org/downloads/sawmill-1.0-x86.gem", None),
    ("https://proxy.golang.org/github.com/!green!heron/wing/@v/v1.0.zip", "pkg:golang/github.com/GreenHeron/wing@v1.0"),
    ("https://api.nuget.org/v3-flatcontainer/json/13.0/json.13.0.nupkg", "pkg:nuget/json@13.0"),
    ("https://repo1.maven.org/maven2/org/a/b/lib/1.0/lib-1.0.jar", "pkg:maven/org.a.b/lib@1.0"),
    ("https://codeload.github.com/o/r/tar.gz/v1", "pkg:github/o/r@v1"),
    ("https://example.com/x", None),
    ("ftp://registry.npmjs.org/a/-/a-1.tgz", None),
]


def test_normalize_and_fixed_point(spark):
    df = spark.createDataFrame(NORMAL, "raw string, want string")
    out = P.normalize(P.normalize(df, "raw"), "normalized", "again").collect()
    assert [(r.raw, r.normalized) for r in out] == NORMAL
    assert all(r.normalized == r.again for r in out)


def test_identity_keeps_only_the_repository(spark):
    df = spark.createDataFrame([("pkg:npm/a@1?x=1&Repository_URL=u&y=2",), ("pkg:npm/a@1?x=1",)], "raw string")
    assert [r.identity for r in P.identity(df, "raw").collect()] == ["pkg:npm/a@1?Repository_URL=u", "pkg:npm/a@1"]


def test_parse_and_coordinate(spark):
    df = spark.createDataFrame([("pkg:npm/%40s/n@1.0?x=1",), ("pkg:npm/n?x=1@2.0",), ("pkg:npm/@s/n",), ("pkg:npm/n",)], "raw string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in P.parse("raw").items()]).collect()]
    assert got == [("npm", "%40s/n", "1.0"), ("npm", "n", "2.0"), ("npm", "", "s/n"), ("npm", "n", None)]
    assert [r[0] for r in df.select(P.coordinate("raw")).collect()][:1] == ["pkg:npm/%40s/n"]


def test_url_to_purl(spark):
    df = spark.createDataFrame(URLS, "url string, want string")
    assert [(r.url, r.purl) for r in P.url_to_purl(df, "url").collect()] == URLS


def test_guards(spark):
    df = spark.createDataFrame([("a/b",), ("a/../b",), ("a b",), ("a#b",), ("..a",), ("",)], "p string")
    assert [tuple(r) for r in df.select(P.safe_coordinate("p"), P.safe_filename_part("p")).collect()] == [(True, False), (False, False), (False, True), (False, False), (True, True), (True, False)]
