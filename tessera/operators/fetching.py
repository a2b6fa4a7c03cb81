"""The fetch pipeline as a plan: select, join the cache, claim the budget, join responses, verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sha256_hex
from ..functions.text import col
from ..sources.stages import meet
from .running import RANGE, ranged, running

#: Fixed values, in seconds: artifact lifetimes by pin, metadata lifetimes by tier, touch interval.
ARTIFACT_PINNED, ARTIFACT_UNPINNED = 7 * 86400, 12 * 3600
METADATA_PINNED, METADATA_UNPINNED = 90 * 86400, 3600
TOUCH_EVERY = 86400
FOREVER = (1 << 63) - 1
MAX_COUNT, MAX_BYTES, RESPONSE_CAP = 512, 5 << 30, 256 << 20


def selected(locator_type, kind, is_target, fetch_urls: bool = False) -> Column:
    """References worth fetching: package URLs, and URLs that are dependencies or commands (or all of them)."""
    urls = F.lit(True) if fetch_urls else col(kind).isin("dependency", "command")
    return col(is_target) & F.when(col(locator_type) == "purl", True).when(col(locator_type) == "url", urls).otherwise(False)


def artifact_lifetime(pinned) -> Column:
    return F.when(col(pinned), F.lit(ARTIFACT_PINNED)).otherwise(F.lit(ARTIFACT_UNPINNED)).cast("bigint")


def metadata_lifetime(tier, override: int | None = None) -> Column:
    """Lifetime of tier ``immutable``, ``pinned`` or ``unpinned``; an override (1 s at least) replaces both mutable ones."""
    mutable = max(1, override) if override is not None else None
    return F.when(col(tier) == "immutable", F.lit(FOREVER)).when(col(tier) == "pinned", F.lit(mutable or METADATA_PINNED)).otherwise(F.lit(mutable or METADATA_UNPINNED)).cast("bigint")


def artifact_key(locator) -> Column:
    return sha256_hex(locator)


def metadata_key(url, headers=None) -> Column:
    """Key of a metadata document: its URL and the request headers that matter, in order."""
    parts = F.concat(F.lit("meta:"), col(url))
    if headers is not None:
        joined = F.array_join(F.transform(col(headers), lambda h: F.concat(h["name"], F.lit(":"), h["value"])), ";")
        parts = F.concat(parts, F.when(F.size(col(headers)) > 0, F.concat(F.lit(":"), joined)).otherwise(""))
    return sha256_hex(parts)


def post_key(url, body) -> Column:
    return sha256_hex(F.concat(F.lit("post:"), col(url), F.lit(":"), sha256_hex(body)))


def request_key(requests: DataFrame) -> Column:
    """Key of each of ``requests(url[, headers][, body])``: by URL and body where there is one (a POST), else by URL and headers."""
    get = metadata_key("url", "headers" if "headers" in requests.columns else None)
    return F.when(F.col("body").isNotNull(), post_key("url", "body")).otherwise(get) if "body" in requests.columns else get


def is_fresh(fetched_at, now, lifetime) -> Column:
    """Whether an entry is no older than its lifetime; one from the future is fresh, no entry is null."""
    return F.when(col(fetched_at).isNotNull(), F.greatest(col(now) - col(fetched_at), F.lit(0)) <= col(lifetime))  # greatest passes over nulls


def needs_touch(last_access, now) -> Column:
    return col(last_access).isNull() | (col(now) - col(last_access) >= TOUCH_EVERY)


def verify_pin(algo, value, content) -> Column:
    """Whether content matches its pin: SHA-256 as hex in any case, SHA-512 as base64; null for other pins."""
    data = col(content).cast("binary")
    sha512 = F.translate(F.base64(F.unhex(F.sha2(data, 512))), "\r\n", "")
    return F.when(col(algo) == "sha256", F.lower(col(value)) == F.sha2(data, 256)).when(col(algo) == "sha512", col(value) == sha512)


def counts_against_budget(cached, outcome) -> Column:
    return ~col(cached) & col(outcome).isin("ok", "pin_mismatch", "failed")


def claim(refs: DataFrame, order: list[str], group: list[str], max_count: int = MAX_COUNT, max_bytes: int = MAX_BYTES, size: str = "size", miss: str = "miss") -> DataFrame:
    """Append ``claimed`` and ``within_bytes``: the first ``max_count`` misses, and rows reached before the bytes ran out.

    Both are prefixes in declared order of one source's references (``group``); the running sums are made
    in ranges, so one source may hold all of them. Bytes of cache hits count, as in a serial run.
    """
    rows = running(ranged(refs, group, order), group, order, {"__misses": F.when(F.col(miss), 1)})
    rows = rows.withColumn("claimed", ~F.col(miss) | (F.col("__misses") < max_count))
    rows = running(rows, group, order, {"__spent": F.when(F.col("claimed"), F.col(size))})
    return rows.withColumn("within_bytes", F.col("__spent") < max_bytes).drop("__misses", "__misses_all", "__spent", "__spent_all", RANGE)


def fetch(refs: DataFrame, cache: DataFrame, responses: DataFrame, now: int, *, max_count: int = MAX_COUNT, max_bytes: int = MAX_BYTES, fetch_urls: bool = False) -> DataFrame:
    """Provenance records of ``refs(source_sha256, seq, locator_type, locator, resolved_url, kind, is_target, pin_algo, pin_value)``.

    ``cache(key, fetched_at, content)`` and ``responses(url, status, content, error)`` are joined by key
    and URL. Fresh cache entries cost no budget; a failed fetch falls back to an entry of any age.
    """
    rows = refs.where(selected("locator_type", "kind", F.lit(True), fetch_urls)).withColumn("key", artifact_key("locator"))
    held = cache.select("key", F.col("fetched_at").alias("c_at"), F.col("content").alias("c_content"))
    got = responses.select(F.col("url").alias("resolved_url"), "status", F.col("content").alias("r_content"), F.col("error").alias("r_error"), F.lit(True).alias("answered"))
    rows = meet(meet(rows, held, "key", "left"), got, "resolved_url", "left")
    fresh = F.coalesce(is_fresh("c_at", F.lit(now), artifact_lifetime(F.col("pin_value").isNotNull())), F.lit(False))
    target = F.col("is_target") & F.col("resolved_url").isNotNull()
    rows = rows.withColumns({"hit": fresh & target, "miss": target & ~fresh})
    good = F.coalesce(F.col("answered"), F.lit(False)) & F.col("r_error").isNull()
    served = F.when(F.col("hit"), "cache").when(good, "network").when(F.col("c_at").isNotNull(), "stale")
    content = F.when(F.col("hit"), F.col("c_content")).when(good, F.col("r_content")).otherwise(F.col("c_content"))
    rows = rows.withColumns({"served": served, "content": content})
    rows = claim(rows.withColumn("size", F.when(target, F.octet_length("content").cast("bigint"))), ["seq"], ["source_sha256"], max_count, max_bytes)
    verified = verify_pin("pin_algo", "pin_value", "content")
    outcome = (
        F.when(~F.col("within_bytes"), "budget_exceeded").when(~F.col("is_target"), "skipped").when(F.col("resolved_url").isNull(), "unresolved").when(~F.col("claimed"), "budget_exceeded")
        .when(F.col("served").isNull(), "failed").when(verified == F.lit(False), "pin_mismatch").otherwise("ok")
    )
    done = rows.withColumn("outcome", outcome).withColumn("here", F.col("outcome").isin("ok", "pin_mismatch"))
    here = lambda c: F.when(F.col("here"), c)
    return done.select(
        "source_sha256", "seq", "kind", "locator", F.when(F.col("within_bytes"), F.col("resolved_url")).alias("resolved_url"), "outcome", F.when(F.col("outcome") == "failed", F.coalesce("r_error", F.lit("no response"))).alias("failure"),
        here(F.col("size")).alias("size"), here(sha256_hex("content")).alias("content_sha256"), F.coalesce(here(F.col("served") != "network"), F.lit(False)).alias("cached"),
        F.coalesce(here(F.col("served") == "stale"), F.lit(False)).alias("stale"), here(verified).alias("pin_verified"),
    )


#: What is noted of an answer beside its bytes, in the cache too.
FACTS = {"status": "int", "content_type": "string"}


def documents(asked: DataFrame, cache: DataFrame, responses: DataFrame, now: int, tier: str = "tier") -> DataFrame:
    """Metadata of ``asked(url, tier[, headers][, body])``: fresh cache, else response, else the cache at any age; each request is looked up once.

    Requests, cache and ``responses(url[, headers][, body], content, error)`` meet by ``request_key``, so a
    POST is known by its URL and body. ``status`` and ``content_type`` are those of the first answer, null
    where cache or responses lack them.
    """
    urls = asked.withColumn("key", request_key(asked)).groupBy("key").agg(F.first("url").alias("url"), F.max(tier).alias(tier))
    facts = lambda side, mark: [(F.col(f) if f in side.columns else F.lit(None).cast(t)).alias(mark + f) for f, t in FACTS.items()]
    held = cache.select("key", F.col("fetched_at").alias("c_at"), F.col("content").alias("c_content"), *facts(cache, "c_"))
    answers = responses.select(request_key(responses).alias("key"), F.col("content").alias("r_content"), F.col("error").alias("r_error"), *facts(responses, "r_"))
    rows = meet(meet(urls, held, "key", "left"), answers, "key", "left")
    fresh = is_fresh("c_at", F.lit(now), metadata_lifetime(tier))
    live = F.when(F.col("r_error").isNull(), F.col("r_content"))
    served = F.when(fresh, "cache").when(live.isNotNull(), "network").when(F.col("c_at").isNotNull(), "stale")
    rows = rows.withColumn("served", served)
    of = lambda name: F.when(F.col("served") == "network", F.col("r_" + name)).when(F.col("served").isNotNull(), F.col("c_" + name)).alias(name)
    return rows.select("url", of("content"), "served", *[of(f) for f in FACTS], "key")


def recorded(reads: DataFrame, served: DataFrame, key: list[str], urls: str = "urls") -> DataFrame:
    """The raw documents that ``reads(*key, urls)`` got, one row a read: (*key, pos, url, status, content_type, content).

    ``pos`` is the place in the array of URLs, so a document read twice appears twice; ``served`` is the
    table of :func:`documents`. Reads that nothing answered, and null URLs, leave no row.
    """
    asked = reads.select(*key, F.posexplode(urls).alias("pos", "url"))
    got = served.where("content IS NOT NULL").select("url", *FACTS, "content")
    return meet(asked, got, "url").select(*key, "pos", "url", *FACTS, "content")
