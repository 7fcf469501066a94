"""Text rules that SQL functions can't express."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OTHER = re.compile("[^A-Za-z0-9]+")


def fold(text: str | None) -> str | None:
    """Lower case, compatibility forms taken apart, and of that the ASCII letters and digits alone."""
    return None if text is None else _OTHER.sub("", unicodedata.normalize("NFKD", text.lower()))


#: Texts that are Python's at once, of the Arrow batch that a task holds.
HELD = 64


@F.arrow_udf(T.StringType())
def _folded(texts: pa.Array) -> pa.Array:
    parts = (texts.slice(k, HELD).to_pylist() for k in range(0, len(texts), HELD))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([fold(text) for text in part], pa.string()) for part in parts)])


def folded(c: str | Column) -> Column:
    """fold() of a column, a batch at a time, some texts of it at once."""
    return _folded(F.col(c) if isinstance(c, str) else c)
