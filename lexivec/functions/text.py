"""String, hash and id functions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word pattern of the tokenizer and the words in font names.
WORD = r"[A-Za-z0-9_]+"
BOLD = "(?i)bold|heavy|black|demi"
ITALIC = "(?i)italic|oblique|slant"


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores; null gives none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)


def strip(text: Column) -> Column:
    """Without white space of any script at either end (Spark's trim knows spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Stripped, with every white-space run as one space."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def term_hash(term: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, an unsigned number. Different terms can meet."""
    return F.crc32(F.encode(term, "utf-8"))


def sha1_prefix(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(F.encode(text, "utf-8")), 1, length)


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name-based UUID that Python's uuid.uuid5 gives."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def chunk_key(source_document: Column, section_path: Column, chunk_index: Column) -> Column:
    """The composite key, its parts joined by a double pipe."""
    return F.concat(source_document, F.lit("||"), F.coalesce(section_path, F.lit("")), F.lit("||"), chunk_index.cast("string"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def join_url(base: str, path: str) -> str:
    return f"{base.rstrip('/')}/{path.lstrip('/')}"


def is_bold(font_name: Column) -> Column:
    return F.coalesce(font_name, F.lit("")).rlike(BOLD)


def is_italic(font_name: Column) -> Column:
    return F.coalesce(font_name, F.lit("")).rlike(ITALIC)


def colour_key(components: Column) -> Column:
    """An array of colour components as text: `default` without any, gray_ for one, else joined by underscores."""
    shown = F.transform(components, lambda x: F.format_string("%.2f", x))
    return F.when(components.isNull() | (F.size(components) == 0), "default").when(F.size(components) == 1, F.concat(F.lit("gray_"), F.element_at(shown, 1))).otherwise(F.array_join(shown, "_"))


def without_fence(reply: Column) -> Column:
    """A reply that starts with a code fence, from its first [ to its last ]; any other reply, stripped."""
    bare = strip(reply)
    return F.when(bare.startswith("```"), F.regexp_extract(bare, r"(?s)\[.*\]", 0)).otherwise(bare)


@F.pandas_udf(T.DoubleType())
def round1(x: pd.Series) -> pd.Series:
    """To one decimal as Python rounds; neither of Spark's roundings agrees on halves. An Arrow batch at a time."""
    return x.map(lambda v: round(v, 1), na_action="ignore")
