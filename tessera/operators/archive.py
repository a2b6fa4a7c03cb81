"""Capped archive sink: the entries of a flattened image as one tar.xz a group."""

from __future__ import annotations

import io
import lzma
import tarfile

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "image string, archive binary, entries long, error string"


class _Capped(io.RawIOBase):
    """Counts what goes through and fails beyond the cap."""

    def __init__(self, sink, cap: int):
        self.sink, self.left = sink, cap

    def writable(self):
        return True

    def write(self, data):
        self.left -= len(data)
        if self.left < 0:
            raise OverflowError("archive is over the cap")
        return self.sink.write(data)


def build(entries: list[tuple], cap: int = 2 << 30, preset: int = 6) -> bytes:
    """tar.xz of (path, type, link target, body) rows in path order; raises beyond ``cap`` uncompressed bytes."""
    out = io.BytesIO()
    with lzma.open(out, "wb", preset=preset) as packed, tarfile.open(fileobj=_Capped(packed, cap), mode="w|") as tar:
        for path, kind, target, body in sorted(entries, key=lambda e: e[0]):
            info = tarfile.TarInfo(path)
            info.type = {"dir": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE, "hardlink": tarfile.LNKTYPE}.get(kind, tarfile.REGTYPE)
            data = (body or "").encode() if isinstance(body, str) else bytes(body or b"")
            info.linkname, info.size = target or "", len(data) if info.type == tarfile.REGTYPE else 0
            tar.addfile(info, io.BytesIO(data) if info.size else None)
    return out.getvalue()


def archives(entries: DataFrame, cap: int = 2 << 30) -> DataFrame:
    """One archive an image of ``entries(image, path, entry_type, link_target, body)``; over the cap: an error row.

    An image is one archive and so one task; :func:`tessera.operators.layers.within_budget` bounds it first.
    """

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["path", "entry_type", "link_target", "body"]].itertuples(index=False, name=None))
        try:
            made, error = build(rows, cap), None
        except OverflowError as e:
            made, error = None, str(e)
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "archive": [made], "entries": [len(rows)], "error": [error]})

    return entries.groupBy("image").applyInPandas(make, SCHEMA)
