"""Unicode normal form in batches, with a short cut for plain text."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from winnowline.functions.text import sanitize

#: Byte order mark and zero-width space.
INVISIBLE = "[\\uFEFF\\u200B]"
#: Bytes of a batch's texts that are Python strings at a time.
PART = 1 << 20
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F]"


@F.arrow_udf(StringType())
def _compatible(text: pa.Array) -> pa.Array:
    # Arrow's own kernel leaves marks uncomposed; unicodedata does a quarter of a gigabyte a second.
    # A batch of long texts goes through in parts of a megabyte or so, for as Python strings they take several times that.
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)) // PART
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(text)]
    parts = [pa.array([x if x is None else unicodedata.normalize("NFKC", x) for x in text.slice(a, b - a).to_pylist()], pa.string()) for a, b in zip(cuts, cuts[1:])]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def normal_form(text: Column) -> Column:
    """NFKC without byte order marks and zero-width spaces; null stays null.

    Invisible and control characters go first, for they would keep apart what composes. ASCII is its own
    normal form: such texts are null to the Arrow kernel and never copied.
    """
    bare = F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), CONTROL, "")
    other = bare.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_compatible(F.when(other, bare)), bare)


def sanitize_unicode(text: Column) -> Column:
    """``sanitize`` of the normal form: doing it again changes nothing."""
    return sanitize(normal_form(text))
