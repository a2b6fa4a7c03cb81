"""Recognition: files of text become rows of external references.

Every recognizer is a narrow chain of explodes over native expressions; rows carry ``branch`` and
``seq`` so that "first wins" is decided by declaration order and not by arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.purl import coordinate
from ..functions.text import BLANK, col, group_of, rx, trim
from ..functions.udfs import decode_escapes

#: Fixed values: (heads, rule, arguments, family). Rules: "now" takes what follows; "verb" skips flags and
#: wants a verb; "then" wants one of these token sequences next; "within" wants a token in the next n.
MANAGERS = [
    (("npx", "bunx"), "now", (), "npm"),
    (("uvx",), "now", (), "pypi"),
    (("npm", "pnpm", "yarn", "bun"), "then", (("global", "add"),), "npm"),
    (("npm", "pnpm", "yarn", "bun"), "verb", ("install", "i", "add", "a", "dlx", "x"), "npm"),
    (("pip", "pip3"), "within", (1, 3, "^install$"), "pypi"),
    (("python", "python3"), "pip module", (3, 3, "^install$"), "pypi"),
    (("pipx",), "then", (("install",), ("run",)), "pypi"),
    (("pipenv",), "verb", ("install",), "pypi"),
    (("poetry", "pdm", "rye"), "verb", ("add",), "pypi"),
    (("uv",), "then", (("pip", "install"), ("tool", "install"), ("add",)), "pypi"),
    (("deno",), "then", (("install",), ("add",), ("cache",), ("run",)), "deno"),
    (("go",), "then", (("get",), ("install",)), "golang"),
    (("cargo",), "verb", ("install", "add", "binstall"), "cargo"),
    (("gem",), "verb", ("install",), "gem"),
    (("bundle", "bundler"), "verb", ("add",), "gem"),
    (("conda", "mamba", "micromamba"), "verb", ("install",), "conda"),
    (("composer",), "then", (("require",), ("global", "require")), "composer"),
    (("apt-get", "apt", "aptitude"), "verb", ("install",), "apt"),
    (("apk",), "verb", ("add",), "apk"),
    (("dnf", "dnf5", "yum", "microdnf", "tdnf"), "verb", ("install",), "fedora"),
    (("zypper",), "verb", ("install", "in"), "opensuse"),
    (("pacman",), "within", (1, 4, "^(-S$|--sync$|-S[yuw])"), "arch"),
    (("yay", "paru", "pikaur", "trizen"), "within", (1, 4, "^(-S$|--sync$|-S[yuw])"), "aur"),
    (("brew",), "verb", ("install", "reinstall"), "homebrew"),
    (("snap",), "verb", ("install",), "snap"),
    (("pkg",), "verb", ("install", "add"), "freebsd"),
    (("pkgin",), "verb", ("install",), "netbsd"),
    (("pkg_add",), "now", (), "openbsd"),
    (("dotnet",), "then", (("add", "package"), ("tool", "install")), "nuget"),
    (("nuget",), "verb", ("install",), "nuget"),
    (("paket",), "verb", ("add",), "nuget"),
    (("cpanm",), "now", (), "cpan"),
    (("cpan",), "then", (("install",),), "cpan"),
    (("cpan",), "now", (), "cpan"),
    (("dart", "flutter"), "then", (("pub", "add"),), "pub"),
]

#: Modules that come with the runtime.
NODE_BUILTINS = (
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode "
    "querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib"
).split()
HOST_MODULES = ["vscode"]
PYTHON_STDLIB = (
    "__future__ abc argparse asyncio base64 builtins collections contextlib copy ctypes datetime functools glob gzip hashlib hmac http importlib inspect io itertools json logging math os pathlib pickle "
    "platform queue random re shutil socket ssl string struct subprocess sys tempfile threading time traceback types typing urllib uuid warnings zipfile zlib"
).split()
#: Endings of arguments that are files and not packages.
FILE_ENDINGS = (".txt", ".whl", ".toml", ".lock", ".cfg", ".tar", ".gz", ".zip", ".py", ".js")


def image_distro(image) -> Column:
    """Distribution that a container image is built on, by its name; null if unknown."""
    img = F.lower(col(image))
    has = lambda *names: img.rlike("|".join(names))
    return (
        F.when(has("wolfi", "chainguard"), "wolfi")
        .when(has("alpine"), "alpine")
        .when(has("ubuntu", "focal", "jammy", "noble", "mantic", "lunar"), "ubuntu")
        .when(has("opensuse", "/suse", "^suse"), "opensuse")
        .when(has("fedora"), "fedora")
        .when(has("archlinux", "^arch$", "^arch:"), "arch")
        .when(has("debian", "bookworm", "bullseye", "trixie", "buster", "-slim", "/slim", "sid"), "debian")
    )


def distro_ecosystem(family, distro) -> Column:
    """The ecosystem of a manager family on a base distribution."""
    family, distro = col(family), col(distro)
    return F.when(family == "apt", F.when(distro == "ubuntu", "ubuntu").otherwise("debian")).when(family == "apk", F.when(distro == "wolfi", "wolfi").otherwise("alpine")).otherwise(family)


def _rules() -> Column:
    """The rules of each head in their order, as a map."""
    held: dict[str, list[Column]] = {}
    for heads, rule, args, family in MANAGERS:
        words = args if rule == "then" else ()
        begin, width, pattern = args if rule in ("within", "pip module") else (0, 0, "")
        one = F.struct(
            F.lit(rule).alias("rule"), F.lit(family).alias("family"), F.array(*[F.lit(v) for v in (args if rule == "verb" else ())]).cast("array<string>").alias("verbs"),
            F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in words]).cast("array<array<string>>").alias("words"), F.lit(begin).alias("begin"), F.lit(width).alias("width"), F.lit(pattern).alias("pattern"),
        )
        for head in heads:
            held.setdefault(head, []).append(one)
    return F.create_map(*[c for head, rules in held.items() for c in (F.lit(head), F.array(*rules))])


def _consumed(toks: Column, at: Column, rule: Column) -> Column:
    """Tokens that a rule takes from place ``at`` on; null if it doesn't apply."""
    token = lambda n: F.get(toks, at + n)
    place = F.array_position(F.transform(F.slice(toks, at + 2, F.size(toks)), lambda t: ~t.startswith("-")), True).cast("int")
    verb = F.get(F.transform(F.array(place), lambda n: F.when((n > 0) & F.array_contains(rule["verbs"], token(n)), n + 1)), F.lit(0))
    then = F.size(F.get(F.filter(rule["words"], lambda ws: F.slice(toks, at + 2, F.size(ws)) == ws), F.lit(0))) + 1
    patterns = dict.fromkeys(args[2] for _, kind, args, _ in MANAGERS if kind in ("within", "pip module"))
    fits = lambda t: F.coalesce(*[F.when(rule["pattern"] == p, t.rlike(p)) for p in patterns])
    hit = F.array_position(F.transform(F.slice(toks, at + 1 + rule["begin"], rule["width"]), fits), True).cast("int")
    found = F.get(F.transform(F.array(hit), lambda n: F.when(n > 0, n + rule["begin"])), F.lit(0))
    return (
        F.when(rule["rule"] == "verb", verb).when(rule["rule"] == "then", then).when(rule["rule"] == "now", F.lit(1))
        .when((rule["rule"] == "within") | (token(1) == "-m") & (token(2) == "pip"), found)
    )


def match_manager(toks: Column) -> Column:
    """Array of at most one struct (family, args_from): the first token place at which a manager's command starts.

    The head's own rules alone are tried, out of a map.
    """
    rules = _rules()

    def here(at: Column) -> Column:
        cases = F.transform(F.element_at(rules, F.get(toks, at)), lambda r: F.struct(r["family"].alias("family"), (at + _consumed(toks, at, r)).alias("args_from")))
        return F.get(F.filter(cases, lambda c: c["args_from"].isNotNull()), F.lit(0))

    heads = [h for rule in MANAGERS for h in rule[0]]
    places = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: F.get(toks, i).isin(*heads))
    return F.slice(F.array_compact(F.transform(places, here)), 1, 1)


def _some(value: Column) -> Column:
    """One row with the value or none if it is null; evaluates it once, where a filter would copy it."""
    return F.explode(F.array_compact(F.array(value)))


def looks_like_package(eco, tok) -> Column:
    eco, tok = col(eco), col(tok)
    scoped = (eco == "npm") & tok.rlike("^@[^/]*/[^/]*$")
    slash = ~tok.contains("/") | scoped | eco.isin("golang", "composer", "deno")
    return tok.rlike("^[A-Za-z0-9@]") & ~tok.contains("://") & slash & ~tok.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in FILE_ENDINGS) + ")$")


def _at(base: Column, version: Column) -> Column:
    return F.when(base.isNotNull(), F.concat(base, F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("@"), version)).otherwise("")))


def npm_token(tok) -> Column:
    tok = col(tok)
    name = F.when(tok.rlike("^.+@[^@]*$"), F.regexp_extract(tok, "^(.+)@[^@]*$", 1)).otherwise(tok)
    version = rx(tok, "^.+@([^@]*)$")
    base = F.when(name.rlike("^@[^/]*/"), F.concat(F.lit("pkg:npm/%40"), F.substr(name, F.lit(2)))).when(name != "", F.concat(F.lit("pkg:npm/"), name))
    return _at(base, version)


def pypi_token(tok) -> Column:
    base = F.regexp_replace(col(tok), F.lit(r"^([^\[\]]*)\[[^\]]*\]"), F.lit("$1"))
    name = F.nullif(F.trim(F.regexp_extract(base, r"^([^=><~!;, ]*)", 1)), F.lit(""))
    return _at(F.concat(F.lit("pkg:pypi/"), name), rx(base, r"^.*?==([^,; ]*)"))


def jsr_token(spec) -> Column:
    name = F.when(col(spec).rlike("^.+@[^@]*$"), F.regexp_extract(col(spec), "^(.+)@[^@]*$", 1)).otherwise(col(spec))
    return _at(F.when(name.rlike("^@[^/]+/.+$"), F.concat(F.lit("pkg:jsr/%40"), F.substr(name, F.lit(2)))), rx(spec, "^.+@([^@]*)$"))


def package_token(eco, tok) -> Column:
    """Package URL of an install argument in an ecosystem; null where it names no package."""
    eco, tok = col(eco), col(tok)
    named = lambda name: F.concat(F.lit("pkg:"), eco, F.lit("/"), F.nullif(name, F.lit("")))
    at = F.instr(tok, "@")
    head = F.when(at > 0, F.substring_index(tok, "@", 1)).otherwise(tok)
    tail = F.when(at > 0, F.substring(tok, at + 1, F.length(tok)))
    conda = F.regexp_extract(tok, "([^:]*(?::[^:]+)*)$", 1)
    conda = F.when(tok.contains("::"), F.substring_index(tok, "::", -1)).otherwise(tok)
    arch = F.substring_index(tok, ":", 1)
    pinned = r"^([^=]*[^=<>~!])=([0-9].*)$"
    distro = F.when(arch.rlike(pinned), F.concat(named(F.regexp_extract(arch, pinned, 1)), F.lit("@"), F.regexp_extract(arch, pinned, 2))).otherwise(named(F.regexp_extract(arch, "^([^=<>~]*)", 1)))
    purl = (
        F.when(eco == "npm", npm_token(tok))
        .when(eco == "pypi", pypi_token(tok))
        .when(eco.isin("golang", "cargo"), _at(named(head), tail))
        .when(eco == "gem", named(tok))
        .when(eco == "conda", _at(named(F.substring_index(conda, "=", 1)), F.regexp_replace(F.substr(conda, F.length(F.substring_index(conda, "=", 1)) + 1), F.lit("^=+"), F.lit(""))))
        .when(eco == "deno", F.when(tok.startswith("npm:"), npm_token(F.substr(tok, F.lit(5)))).when(tok.startswith("jsr:"), jsr_token(F.substr(tok, F.lit(5)))))
        .when(eco == "composer", F.when(F.substring_index(tok, ":", 1).contains("/"), named(F.substring_index(tok, ":", 1))))
        .when(eco.isin("debian", "ubuntu", "alpine", "wolfi", "fedora", "opensuse", "arch", "aur", "freebsd", "netbsd", "openbsd"), distro)
        .when(eco.isin("homebrew", "snap", "pub"), named(F.regexp_extract(tok, "^([^:=@]*)", 1)))
        .when(eco.isin("nuget", "cpan"), named(tok))
    )
    return F.when(looks_like_package(eco, tok), purl)


#: Where a stage of a Dockerfile begins: before a segment whose first word is FROM.
_STAGE = rf"(?<=[;&|\n\r])(?=[{BLANK}]*(?i:FROM)(?:[{BLANK};&|]|\z))"


def command_segments(files: DataFrame, text: str = "text", source: str = "file_type", key: str = "file_id") -> DataFrame:
    """Command segments with their tokens; Dockerfile ``FROM`` sets, or resets, the base distribution of later ones.

    A file is cut into its stages first, so each stage knows its base and nothing is shuffled.
    """
    docker = F.col(source) == "dockerfile"
    joined = F.regexp_replace(F.col(text), F.lit("\\\\\r?\n"), F.lit(" "))
    words = lambda x: F.split(x, f"[{BLANK}]+")
    starts = lambda tokens: F.coalesce(F.upper(F.get(tokens, F.lit(0))) == "FROM", F.lit(False))
    rest = [c for c in files.columns if c != text]
    rows = files.select(*rest, F.explode(F.array(joined)).alias("whole"))  # evaluated once
    rows = rows.select(*rest, F.posexplode(F.when(docker, F.split("whole", _STAGE)).otherwise(F.array("whole"))).alias("stage", "block"))
    opening = words(trim(F.regexp_extract("block", rf"^[{BLANK};&|]*([^;&|\n\r]*)", 1)))
    image = F.get(F.filter(F.slice(opening, 2, F.greatest(F.size(opening) - 1, F.lit(0))), lambda t: ~t.startswith("-")), F.lit(0))
    base = F.when(docker & starts(opening) & ~image.startswith("$") & (image != "scratch"), image_distro(image))
    rows = rows.withColumn("distro", base)
    rows = rows.select(*[c for c in rows.columns if c not in ("stage", "block")], "stage", F.posexplode(F.split("block", "[;&|\n\r]")).alias("seg_pos", "segment"))
    cut = trim("segment")
    rows = rows.withColumn("made", F.explode(F.array(F.struct(cut.alias("segment"), words(cut).alias("tokens")))))  # evaluated once
    rows = rows.withColumns({"segment": F.col("made.segment"), "tokens": F.col("made.tokens")}).where("segment <> ''").drop("made")
    place = F.col("stage").cast("bigint") * (1 << 32) + F.col("seg_pos")
    return rows.where(~(docker & starts(F.col("tokens")))).withColumn("seg_pos", place).drop("stage")


_REF = ("locator_type", "locator", "kind", "source", "evidence")


def commands(files: DataFrame, text: str = "text", source: str = "file_type", key: str = "file_id") -> DataFrame:
    """Packages that install commands name: (key, pos, sub, locator_type, locator, kind, source, evidence)."""
    segs = command_segments(files.select(key, source, text), text, source, key).withColumn("m", F.explode(match_manager(F.col("tokens"))))
    args = F.slice("tokens", F.col("m.args_from") + 1, F.size("tokens"))
    stop = F.array_position(F.transform(args, lambda t: t.rlike("^[<>]") | (t == "{")), True).cast("int")
    rows = segs.withColumn("eco", distro_ecosystem("m.family", "distro")).select(key, source, "segment", "seg_pos", "eco", F.posexplode(F.when(stop > 0, F.slice(args, F.lit(1), stop - 1)).otherwise(args)).alias("sub", "tok"))
    out = rows.withColumn("locator", _some(package_token("eco", "tok")))
    return out.select(key, F.col("seg_pos").alias("pos"), "sub", F.lit("purl").alias("locator_type"), "locator", F.lit("command").alias("kind"), F.col(source).alias("source"), F.col("segment").alias("evidence"))


def _lines(files: DataFrame, text: str, source: str, key: str) -> DataFrame:
    return files.select(key, F.col(source).alias("source"), F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))


#: A URL runs to white space or one of these delimiters and must be longer than its scheme.
URL_PATTERN = f"https?://[^{BLANK}\"'|;`<>(),]*"


def extract_urls(text) -> Column:
    """All http(s) URLs of a text, in order."""
    return F.filter(F.regexp_extract_all(col(text), F.lit(URL_PATTERN), 0), lambda u: F.octet_length(u) > 8)


def urls(files: DataFrame, text: str = "text", source: str = "file_type", key: str = "file_id") -> DataFrame:
    rows = _lines(files, text, source, key).select(key, "source", "pos", "line", F.posexplode(extract_urls("line")).alias("sub", "locator"))
    return rows.select(key, "pos", "sub", F.lit("url").alias("locator_type"), "locator", F.lit("url_fetch").alias("kind"), "source", trim("line").alias("evidence"))


def git_target(target) -> Column:
    """A repository URL without quotes and trailing ``.git``; null unless it is one."""
    bare = F.regexp_replace(col(target), F.lit("^[\"'`)\\],]+|[\"'`)\\],]+$"), F.lit(""))
    return F.when((bare.contains("://") | bare.startswith("git@")) & (F.octet_length(bare) >= 8), F.regexp_replace(bare, F.lit(r"(?:\.git)+$"), F.lit("")))


def git_refs(files: DataFrame, text: str = "text", source: str = "file_type", key: str = "file_id") -> DataFrame:
    specs = F.regexp_extract_all("line", F.lit(f"git\\+([^{BLANK}\"'`,()\\[\\]]*)"), 1)
    clone = F.regexp_extract("line", rf"(?:^|[{BLANK}])git[{BLANK}]+clone[{BLANK}]+(?:-[^{BLANK}]*[{BLANK}]+)*([^-{BLANK}][^{BLANK}]*)", 1)
    found = F.filter(F.transform(F.concat(specs, F.array(clone)), git_target), lambda x: x.isNotNull())
    rows = _lines(files, text, source, key).select(key, "source", "pos", "line", F.posexplode(found).alias("sub", "locator"))
    return rows.select(key, "pos", "sub", F.lit("url").alias("locator_type"), "locator", F.lit("repository").alias("kind"), "source", trim("line").alias("evidence"))


def import_locator(eco, spec) -> Column:
    """Struct (locator_type, locator, kind) that an import specifier stands for; null for relative and built-in ones."""
    eco, spec = col(eco), col(spec)
    name = "[A-Za-z0-9._-]+"
    bare = F.regexp_replace(spec, F.lit("^node:"), F.lit(""))
    npm = F.when(~bare.isin(*NODE_BUILTINS, *HOST_MODULES), npm_token(F.coalesce(rx(spec, f"^(@{name}/{name})(?:/.*)?$"), rx(spec, f"^({name})(?:/.*)?$"))))
    top = F.regexp_extract(spec, "^([^.:]*)", 1)
    python = F.when(~top.isin(*PYTHON_STDLIB) & top.rlike(f"^{name}$"), pypi_token(top))
    purl = F.when(eco == "npm", npm).when(eco == "pypi", python)
    made = lambda kind, value, what: F.struct(F.lit(kind).alias("locator_type"), value.alias("locator"), F.lit(what).alias("kind"))
    return F.when(spec.contains("://"), made("url", spec, "url_fetch")).when(~spec.rlike("^[./]") & purl.isNotNull(), made("purl", purl, "command"))


def dynamic_imports(files: DataFrame, text: str = "text", source: str = "file_type", key: str = "file_id") -> DataFrame:
    """References of ``import(...)`` and Python's import functions with a leading string literal."""
    literal = "\\(\\s*(\"[^\"$ \\n\\t]+\"|'[^'$ \\n\\t]+'|`[^`$ \\n\\t]+`)"
    python = F.col(source) == "python"
    specs = F.when(python, F.concat(F.regexp_extract_all(text, F.lit("__import__" + literal), 1), F.regexp_extract_all(text, F.lit("import_module" + literal), 1))).otherwise(F.regexp_extract_all(text, F.lit("import" + literal), 1))
    rows = files.select(key, F.col(source).alias("source"), F.when(python, "pypi").otherwise("npm").alias("eco"), F.posexplode(specs).alias("sub", "quoted"))
    rows = rows.withColumn("spec", F.substring("quoted", F.lit(2), F.length("quoted") - 2)).withColumn("plain", F.when(F.col("spec").contains("\\"), decode_escapes()("spec")).otherwise(F.col("spec")))
    rows = rows.withColumn("r", _some(import_locator("eco", "plain")))
    return rows.select(key, F.lit(0).alias("pos"), "sub", "r.locator_type", "r.locator", "r.kind", "source", F.col("spec").alias("evidence"))


def import_calls(symbols: DataFrame, key: str = "file_id") -> DataFrame:
    """References of module-loading calls among ``symbols(file_id, pos, file_type, target, args, offset)``."""
    js = F.col("file_type").isin("javascript", "typescript") & F.col("target").isin("require", "import")
    py = (F.col("file_type") == "python") & F.col("target").isin("__import__", "import_module", "importlib.import_module")
    first = F.get("args", F.lit(0))
    rows = symbols.where(js | py).where(first["kind"] == "string").withColumn("spec", first["value"])
    rows = rows.withColumn("plain", F.when(F.col("spec").contains("\\"), decode_escapes()("spec")).otherwise(F.col("spec"))).withColumn("r", _some(import_locator(F.when(py, "pypi").otherwise("npm"), "plain")))
    return rows.select(key, "pos", F.lit(0).alias("sub"), "r.locator_type", "r.locator", "r.kind", F.lit("ast-call").alias("source"), F.col("spec").alias("evidence"), F.coalesce("offset", F.lit(0).cast("bigint")).alias("offset"))


def npm_hooks(facts: DataFrame, key: str = "file_id", values: str = "values") -> DataFrame:
    """References in the npm install hooks of a JSON document: of each hook URLs first, then commands."""
    hooks = ("preinstall", "install", "postinstall")
    doc = F.try_parse_json(F.col(values))
    is_text = lambda path: F.schema_of_variant(F.try_variant_get(doc, path, "variant")) == "STRING"
    each = F.array(*[F.struct(F.lit(i).alias("hook"), F.lit(f"npm.scripts.{h}").alias("source"), F.when(is_text(f"$.npm.scripts.{h}"), F.try_variant_get(doc, f"$.npm.scripts.{h}", "string")).alias("cmd")) for i, h in enumerate(hooks)])
    rows = facts.select(key, F.inline(each)).where("cmd IS NOT NULL")
    found = rows.select(key, "hook", "source", "cmd", F.posexplode(extract_urls("cmd")).alias("sub", "locator"))
    links = found.select(key, (F.col("hook") * 2).alias("pos"), "sub", F.lit("url").alias("locator_type"), "locator", F.lit("url_fetch").alias("kind"), "source", F.col("cmd").alias("evidence"))
    flat = rows.withColumn("unit", F.struct(key, "hook"))
    runs = commands(flat.select("unit", "source", "cmd"), "cmd", "source", "unit")
    return links.unionByName(runs.select(f"unit.{key}", (F.col("unit.hook") * 2 + 1).alias("pos"), (F.col("pos").cast("bigint") * (1 << 32) + F.col("sub")).alias("sub"), *_REF))


def extracted_refs(strings: DataFrame, key: str = "file_id") -> DataFrame:
    """URLs inside extracted strings ``(file_id, value, data_offset)``; the offset is the string's own."""
    rows = strings.select(key, "data_offset", "value", F.posexplode(extract_urls("value")).alias("sub", "locator"))
    return rows.select(key, F.col("data_offset").alias("pos"), "sub", F.lit("url").alias("locator_type"), "locator", F.lit("url_fetch").alias("kind"), F.lit("string").alias("source"), F.col("value").alias("evidence"), F.col("data_offset").alias("offset"))


def source_text(text) -> Column:
    """Source code as command text: punctuation to blanks, braces as tokens of their own."""
    return F.regexp_replace(F.translate(col(text), ".()[],\"':", "         "), F.lit(r"([{}])"), F.lit(" $1 "))


def dedup_first(refs: DataFrame, partition: list[str], order: list) -> DataFrame:
    """Keep the first row of each locator string by declared order; ties are for the caller's order to break."""
    rank = F.row_number().over(Window.partitionBy(*partition, "locator").orderBy(*order))
    return refs.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def references(files: DataFrame, declared: DataFrame | None = None, facts: DataFrame | None = None, strings: DataFrame | None = None, text: bool = True, offsets: bool = True) -> DataFrame:
    """All references of ``files(file_id, file_type, text)``: declared, npm hooks, strings, text; first locator wins.

    Without ``offsets`` the texts aren't joined to the references again.
    """
    cols = ["file_id", "branch", "pos", "sub", *_REF]
    parts = []
    tag = lambda df, n: df.withColumn("branch", F.lit(n)).select(*cols)
    if declared is not None:
        parts.append(tag(declared.withColumnRenamed("seq", "pos").withColumn("sub", F.lit(0)), 0))
    if facts is not None:
        parts.append(tag(npm_hooks(facts), 1))
    if strings is not None and text:
        parts.append(tag(extracted_refs(strings), 2))
    if text:
        code = F.col("file_type").isin("javascript", "typescript", "python")
        read = files.where(code | F.col("file_type").isin("shell", "dockerfile"))
        plain = read.withColumn("text", F.when(code, source_text("text")).otherwise(F.col("text")))
        parts += [tag(commands(plain), 3), tag(git_refs(read), 4), tag(urls(read), 5), tag(dynamic_imports(files.where(code)), 6)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = dedup_first(out, ["file_id"], ["branch", "pos", "sub", "kind"])
    return with_offset(first, files) if offsets else first


def anchor(locator_type, locator) -> Column:
    """Text to look for in a file when the evidence isn't found: the package's name or the URL."""
    name = F.regexp_extract(F.regexp_replace(col(locator), F.lit("^pkg:(?:[^/]*/)?"), F.lit("")), "^([^@]*)", 1)
    return F.when(col(locator_type) == "purl", F.replace(name, F.lit("%40"), F.lit("@"))).otherwise(col(locator))


def byte_offset(text, part) -> Column:
    """Bytes before the first occurrence of ``part``; null if there is none."""
    place = F.instr(col(text), col(part))
    return F.when(place > 0, F.octet_length(F.substring(col(text), F.lit(1), place - 1)).cast("long"))


def with_offset(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Append ``offset``: where the evidence, else the anchor, starts in the file's bytes; 0 if neither does."""
    joined = refs.join(files.select("file_id", F.col("text").alias("__text")), "file_id", "left")
    return joined.withColumn("offset", F.coalesce(byte_offset("__text", "evidence"), byte_offset("__text", anchor("locator_type", "locator")), F.lit(0).cast("long"))).drop("__text")


def undeclared_packages(refs: DataFrame, package: str = "package_id", declared: DataFrame | None = None) -> DataFrame:
    """Packages that commands install and no dependency declares, versions apart: one anti-join by coordinate.

    Dependencies are looked for in ``refs``, or in ``declared`` alone, so that ``refs`` are made once.
    """
    keyed = lambda df: df.where("locator_type = 'purl'").withColumn("coordinate", coordinate("locator"))
    known = keyed(refs if declared is None else declared).where("kind = 'dependency'").select(package, "coordinate").distinct()
    return keyed(refs).where("kind = 'command'").join(known, [package, "coordinate"], "left_anti")


def file_type(path, first_line) -> Column:
    """Kind of a file by its name, else by its first line."""
    name = F.lower(F.substring_index(col(path), "/", -1))
    return (
        F.when(name.rlike(r"^(?:dockerfile|containerfile)(?:\..*)?$|\.dockerfile$"), "dockerfile")
        .when(name.rlike(r"\.(?:sh|bash|zsh|ksh)$") | col(first_line).rlike(r"^#!.*\b(?:ba|z|k|da)?sh\b"), "shell")
        .when(name.rlike(r"\.(?:js|mjs|cjs|jsx)$") | col(first_line).rlike(r"^#!.*\bnode\b"), "javascript")
        .when(name.rlike(r"\.(?:ts|tsx|mts|cts)$"), "typescript")
        .when(name.rlike(r"\.pyw?$") | col(first_line).rlike(r"^#!.*\bpython"), "python")
        .otherwise("other")
    )
