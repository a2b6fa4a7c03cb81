"""Reading string columns that may hold bytes which aren't UTF-8."""

from __future__ import annotations


def texts(column):
    """The values of an Arrow string column one by one; bytes that aren't UTF-8 become U+FFFD."""
    for x in column:
        try:
            yield x.as_py()
        except UnicodeDecodeError:
            yield x.as_buffer().to_pybytes().decode("utf-8", "replace")
