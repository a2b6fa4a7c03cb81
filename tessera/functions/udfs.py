"""Arrow functions for what no built-in expresses (escapes, codecs), and plain ones that the live source's guard uses."""

from __future__ import annotations

import gzip
import io
import ipaddress
import lzma
import re
import tarfile

import pandas as pd
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([0-7]{1,3})|(.))", re.S)
_CONTROL = dict(zip("nrtbfv", "\n\r\t\b\f\v"))
_PERCENT = re.compile(rb"%([0-9a-fA-F]{2})")


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if code or m[4]:
        value = int(code, 16) if code else int(m[4], 8)
        return m[0] if value > 0x10FFFF or 0xD800 <= value <= 0xDFFF else chr(value)
    return m[0] if m[5] in "ux" else _CONTROL.get(m[5], m[5])


def unescape_one(s: str | None) -> str | None:
    """A string literal with its escapes decoded; lone surrogates and malformed escapes stay."""
    return s if s is None or "\\" not in s else _ESCAPE.sub(_unescape, s)


def percent_decode_one(s: str | None) -> str | None:
    """Percent escapes decoded; malformed ones and + stay, bad UTF-8 becomes U+FFFD."""
    return s if s is None or "%" not in s else _PERCENT.sub(lambda m: bytes([int(m[1], 16)]), s.encode()).decode("utf-8", "replace")


#: Blocks that a fetcher must not reach besides what the standard marks (fixed values).
_V4_BLOCKED = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")]
_V6_BLOCKED = [ipaddress.ip_network(n) for n in ("::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8", "64:ff9b:1::/48", "2001::/32", "2001:db8::/32")]


def blocked_ip_one(s: str | None) -> bool | None:
    """Whether an address is private, local or reserved, also when a v6 form carries it; null if it is no address."""
    try:
        ip = ipaddress.ip_address(s)
    except ValueError:
        return None
    if ip.version == 6:
        raw = int(ip)
        inner = None
        if ip.ipv4_mapped or raw >> 32 == 0 and raw > 1 or raw >> 96 == 0x0064FF9B:
            inner = raw & 0xFFFFFFFF
        elif raw >> 112 == 0x2002:
            inner = raw >> 80 & 0xFFFFFFFF
        if inner is not None and any(ipaddress.ip_address(inner) in n for n in _V4_BLOCKED):
            return True
        return any(ip in n for n in _V6_BLOCKED)
    return any(ip in n for n in _V4_BLOCKED)


def gunzip_one(data: bytes | None, cap: int) -> bytes | None:
    """A gzip body (several members too) or the plain bytes; null when malformed or over ``cap``."""
    if data is None or data[:2] != b"\x1f\x8b":
        return data if data is None or len(data) <= cap else None
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            out = f.read(cap + 1)
    except (OSError, EOFError):
        return None
    return out if len(out) <= cap else None


def unxz_one(data: bytes | None, cap: int) -> bytes | None:
    try:
        with lzma.open(io.BytesIO(data)) as f:
            out = f.read(cap + 1)
    except (lzma.LZMAError, EOFError, TypeError):
        return None
    return out if len(out) <= cap else None


def unzstd_one(data: bytes | None, cap: int) -> bytes | None:
    import zstandard

    try:
        out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read(cap + 1)
    except (zstandard.ZstdError, TypeError):
        return None
    return out if len(out) <= cap else None


def tar_member_one(data: bytes | None, name: str, cap: int) -> bytes | None:
    """The first member called ``name`` or ``.../name``; zero blocks between streams are passed over."""
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:", ignore_zeros=True) as tar:
            for m in tar:
                if m.isfile() and (m.name == name or m.name.endswith("/" + name)) and m.size <= cap:
                    return tar.extractfile(m).read()
    except (tarfile.TarError, TypeError):
        pass
    return None


def _lift(one, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or x is pd.NA else one(x))

    return run


def decode_escapes():
    return _lift(unescape_one, "string")


def maybe_gunzip(cap: int = 64 << 20):
    return _lift(lambda b: gunzip_one(bytes(b), cap), "binary")


def unxz(cap: int = 512 << 20):
    return _lift(lambda b: unxz_one(bytes(b), cap), "binary")


def unzstd(cap: int = 256 << 20):
    return _lift(lambda b: unzstd_one(bytes(b), cap), "binary")


def tar_member(name: str, cap: int = 512 << 20):
    return _lift(lambda b: tar_member_one(bytes(b), name, cap), "binary")
