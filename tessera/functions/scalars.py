"""Date, text and markup functions that the registry normalizers use; all native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, group_of, lower_ascii, rx, trim


def _int(text: Column) -> Column:
    """Digits with an optional sign as a number; null for anything else, blanks included."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Day number of a proleptic Gregorian date, counted from 1970-01-01; month and day aren't checked.

    Years start in March here, so that the leap day is the last of its year and months fall into a
    fixed pattern of 153 days for every five.
    """
    y = year - F.when(month <= 2, 1).otherwise(0)
    era = F.floor(y / 400).cast("bigint")
    of_era = y - era * 400
    m = F.pmod(month + 9, F.lit(12))
    of_year = F.floor((m * 153 + 2) / 5).cast("bigint") + day - 1
    return era * 146097 + of_era * 365 + F.floor(of_era / 4).cast("bigint") - F.floor(of_era / 100).cast("bigint") + of_year - 719468


def rfc3339_seconds(value) -> Column:
    """Epoch seconds of ``YYYY-MM-DD?HH:MM:SS``, with an optional fraction and zone; null if malformed or negative.

    What follows ``Z`` or an offset isn't looked at, and an offset's minutes may be missing.
    """
    s = col(value)
    at = lambda p, n: _int(F.substring(s, p, n))
    rest = F.regexp_replace(F.substr(s, F.lit(20)), F.lit(r"^\.[0-9]*"), F.lit(""))
    pair = lambda p: F.when(F.length(rest) >= p + 1, _int(F.substring(rest, p, 2)))
    minutes = pair(2) * 60 + F.coalesce(F.when(F.substring(rest, 4, 1) == ":", pair(5)).otherwise(pair(4)), F.lit(0))
    sign = F.substring(rest, 1, 1)
    shift = F.when(sign.isin("", "Z", "z"), F.lit(0)).when(sign == "+", minutes).when(sign == "-", -minutes)
    total = days_from_civil(at(1, 4), at(6, 2), at(9, 2)) * 86400 + at(12, 2) * 3600 + at(15, 2) * 60 + at(18, 2) - shift * 60
    return F.when((F.octet_length(s) >= 19) & (total >= 0), total)


def timestamp_seconds(value) -> Column:
    """:func:`rfc3339_seconds`, else of the first 19 characters."""
    return F.coalesce(rfc3339_seconds(value), rfc3339_seconds(F.substring(col(value), 1, 19)))


def ymd_seconds(value) -> Column:
    """Epoch seconds of a date at the start of a text."""
    s = col(value)
    total = days_from_civil(_int(F.substring(s, 1, 4)), _int(F.substring(s, 6, 2)), _int(F.substring(s, 9, 2))) * 86400
    return F.when((F.octet_length(s) >= 10) & (total >= 0), total)


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def month_day_year_seconds(value) -> Column:
    """Epoch seconds of a date such as ``March 5, 2024``: a month's whole name in any case, a day, a comma, a year."""
    s = trim(value)
    rest = F.when(F.instr(s, " ") > 0, F.substr(s, F.instr(s, " ") + 1))
    month = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), lower_ascii(F.substring_index(s, " ", 1)))
    after = F.when(F.instr(rest, ",") > 0, F.substr(rest, F.instr(rest, ",") + 1))
    total = days_from_civil(_int(trim(after)), month, _int(trim(F.substring_index(rest, ",", 1)))) * 86400
    return F.when((month > 0) & (total >= 0), total)


def millis_seconds(value) -> Column:
    """Milliseconds, as number or digits, to whole seconds."""
    ms = _int(col(value).cast("string"))
    return F.when(ms >= 0, F.floor(ms / 1000).cast("bigint"))


def meta_content(html, name: str) -> Column:
    """Content of a meta property such as ``og:description``; '' where it is empty."""
    return group_of(html, f'property="{re.escape(name)}" content="([^"]*)"')


def text_after(html, marker: str) -> Column:
    """First text run in the 400 characters after a marker, tags and stray ``>`` passed over."""
    place = F.instr(col(html), marker)
    near = F.substring(col(html), place + len(marker), F.lit(400))
    runs = F.transform(F.split(F.regexp_replace(near, "<[^>]*>?", "\0"), "\0"), lambda t: trim(F.replace(t, F.lit(">"), F.lit(""))))
    return F.when(place > 0, F.get(F.filter(runs, lambda t: t != ""), F.lit(0)))


def number_before(html, marker: str) -> Column:
    """The number (digits, points, commas) that ends right before the first occurrence of a marker."""
    return F.when(F.instr(col(html), marker) > 0, rx(F.substring_index(col(html), marker, 1), r"([0-9.,]+)\z"))


def grouped_number(text) -> Column:
    """A number with thousands separators."""
    return _int(F.replace(col(text), F.lit(","), F.lit("")))


def strip_html(text) -> Column:
    """Text outside tags, trimmed; an unclosed tag takes the rest."""
    return trim(F.replace(F.regexp_replace(col(text), "<[^>]*>?", ""), F.lit(">"), F.lit("")))


def strip_email(text) -> Column:
    """A name without the address in angle brackets behind it; '' where there is only an address."""
    return trim(F.substring_index(col(text), "<", 1))


def first_line(text) -> Column:
    """The first line that isn't blank, trimmed."""
    return F.get(F.filter(F.transform(F.split(col(text), "\n"), trim), lambda t: t != ""), F.lit(0))


def email_domain(address) -> Column:
    """Lower-cased host after the last @; null if there is none."""
    return lower_ascii(rx(address, r"@([A-Za-z0-9.-]+)[^@]*$"))


def stanza_field(stanza, key: str) -> Column:
    """First line ``key:value`` of a stanza, trimmed; empty is null."""
    return F.nullif(trim(F.regexp_extract(col(stanza), f"(?md)^{re.escape(key)}(.*)$", 1)), F.lit(""))


def unescape_xml(text) -> Column:
    out = col(text)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def tag_text(xml, tag: str) -> Column:
    """Text of the first element of that name without attributes, trimmed; '' where it is empty."""
    return unescape_xml(trim(group_of(xml, f"(?s)<{tag}>(.*?)</{tag}>")))


def tag_attribute(xml, tag: str, name: str) -> Column:
    """An attribute, as it is written, of the first element whose name begins so."""
    return group_of(group_of(xml, f"<{tag}([^>]*)>"), f'{name}="([^"]*)"')


def primary_href(repomd) -> Column:
    """Location of the first ``primary`` data element of a repository index."""
    return group_of(group_of(repomd, r'(?s)<data (type="primary"(?:(?!<data ).)*)'), 'href="([^"]*)"')


def sound_xml(xml) -> Column:
    """The text where it is well-formed XML, else null (XPath functions fail on other texts)."""
    broken = F.from_xml(F.when(trim(xml) != "", col(xml)), "__broken string", {"columnNameOfCorruptRecord": "__broken", "mode": "PERMISSIVE"})["__broken"]
    return F.when((trim(xml) != "") & broken.isNull(), col(xml))


def sha256_hex(data) -> Column:
    return F.sha2(col(data).cast("binary"), 256)


def header(headers, name: str) -> Column:
    """First header of that name, any case, in an array of (name, value)."""
    return F.get(F.filter(col(headers), lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = r"\.".join([_OCTET] * 4)


def _blocked_quad(a: Column, b: Column, c: Column) -> Column:
    """Whether the first three octets are of a private, local, reserved or multicast network."""
    return (
        a.isin(0, 10, 127) | (a >= 224)
        | (a == 100) & b.between(64, 127) | (a == 169) & (b == 254) | (a == 172) & b.between(16, 31) | (a == 192) & (b == 168)
        | (a == 192) & (b == 0) & c.isin(0, 2) | (a == 198) & b.isin(18, 19) | (a == 198) & (b == 51) & (c == 100) | (a == 203) & (b == 0) & (c == 113)
    )


def blocked_ipv4(address) -> Column:
    """Whether a dotted quad is private, local, reserved or multicast; null if it is none."""
    pattern = f"^{_QUAD}\\z"
    a, b, c = (F.regexp_extract(col(address), pattern, i).try_cast("int") for i in (1, 2, 3))
    return F.when(col(address).rlike(pattern), _blocked_quad(a, b, c))


def hextets(address) -> Column:
    """The eight 16-bit numbers of a v6 address in any spelling (``::``, a dotted quad at the end); null if it is none."""
    s = col(address)
    tail = f"^(.*:){_QUAD}\\z"
    octet = lambda i: F.regexp_extract(s, tail, i).try_cast("int")
    plain = F.when(s.rlike(tail), F.concat(F.regexp_extract(s, tail, 1), F.hex(octet(2) * 256 + octet(3)), F.lit(":"), F.hex(octet(4) * 256 + octet(5)))).otherwise(s)
    halves = F.split(plain, "::")
    groups = lambda i: F.when(F.get(halves, F.lit(i)) != "", F.split(F.get(halves, F.lit(i)), ":")).otherwise(F.array().cast("array<string>"))
    left, right = groups(0), groups(1)
    known = F.size(left) + F.size(right)
    whole = F.when((F.size(halves) == 1) & (known == 8), left).when((F.size(halves) == 2) & (known <= 7), F.concat(left, F.array_repeat(F.lit("0"), 8 - known), right))
    numbers = F.transform(whole, lambda g: F.when(g.rlike(r"^[0-9a-fA-F]{1,4}\z"), F.conv(g, 16, 10).try_cast("int")))
    return F.when(F.forall(numbers, lambda n: n.isNotNull()), numbers)


def blocked_ipv6(address) -> Column:
    """Whether a v6 address is local, reserved or multicast, or carries a v4 address that is blocked; null if it is none.

    Mapped and compatible addresses are judged as the v4 address alone; relayed (``2002:``) and
    translated ones (``64:ff9b:``) are blocked with theirs.
    """
    parts = hextets(address)

    def judge(h: Column) -> Column:
        at = lambda i: F.get(h, F.lit(i))
        quad = lambda i: _blocked_quad(F.shiftright(at(i), 8), at(i).bitwiseAND(255), F.shiftright(at(i + 1), 8))
        zeros = F.forall(F.slice(h, 1, 5), lambda n: n == 0)
        carried = (at(0) == 0x2002) & quad(1) | (at(0) == 0x64) & (at(1) == 0xFF9B) & quad(6)
        own = (
            (at(0) >= 0xFF00) | at(0).between(0xFC00, 0xFDFF) | at(0).between(0xFE80, 0xFEBF) | (at(0) == 0x64) & (at(1) == 0xFF9B) & (at(2) == 1)
            | (at(0) == 0x2001) & ((at(1) == 0) | (at(1) == 0xDB8))
        )
        return F.when(zeros & at(5).isin(0, 0xFFFF), quad(6)).otherwise(carried | own)

    return F.get(F.transform(F.array_compact(F.array(parts)), judge), F.lit(0))  # the numbers are made once


def blocked_ip(address) -> Column:
    """Whether an address of either kind must not be reached; null if it is no address."""
    return F.coalesce(blocked_ipv4(address), blocked_ipv6(address))


def percent_decoded(text) -> Column:
    """Percent escapes decoded byte by byte; malformed ones and + stay, bytes that aren't UTF-8 become U+FFFD."""
    s = col(text)
    digit = "(?:3[0-9]|[46][1-6])"
    pieces = F.split(F.regexp_replace(F.hex(s.cast("binary")), "(..)", "$1 "), "25 ")
    nibble = lambda code: F.when(code.startswith("3"), F.substring(code, 2, 1)).otherwise(F.translate(F.substring(code, 2, 1), "123456", "ABCDEF"))
    decoded = lambda p: F.when(p.rlike(f"^{digit} {digit} "), F.concat(nibble(F.substring(p, 1, 2)), nibble(F.substring(p, 4, 2)), F.substr(p, F.lit(6)))).otherwise(F.concat(F.lit("25 "), p))
    bytes_ = F.unhex(F.replace(F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(decoded(p))), ""), F.lit(" "), F.lit("")))
    return F.when(s.contains("%"), F.make_valid_utf8(bytes_.cast("string"))).otherwise(s)
