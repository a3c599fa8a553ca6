"""Semi-structured columns and coded values.

A document is a ``variant`` column. It can be neither grouped nor compared, so
jobs take typed scalars out of it before anything else. Paths are
case-sensitive; a missing path, a path through an array and a value of another
type all give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doc_get(document: Column | str, path: str, kind: str = "string") -> Column:
    """Typed scalar at a dotted path."""
    return F.try_variant_get(document, f"$.{path}", kind)


def doc_list(document: Column | str, path: str) -> Column:
    """The documents of an array at a dotted path; a single document there is an array of one, a missing path an empty one."""
    single = F.try_variant_get(document, f"$.{path}", "variant")
    listed = F.try_variant_get(document, f"$.{path}", "array<variant>")
    return F.coalesce(listed, F.array_compact(F.array(single)))


def with_documents(df: DataFrame, *names: str) -> DataFrame:
    """Turn JSON text columns into documents; variant columns stay as they are."""
    texts = [name for name in names if isinstance(df.schema[name].dataType, T.StringType)]
    return df.withColumns({name: F.try_parse_json(name) for name in texts}) if texts else df


def decode_codes(code: Column, labels: tuple[str, ...]) -> Column:
    """Label number ``code`` of ``labels``, counted from zero; other codes give NULL."""
    chain = F.when(code == 0, F.lit(labels[0]))
    for number, label in enumerate(labels[1:], start=1):
        chain = chain.when(code == number, F.lit(label))
    return chain
