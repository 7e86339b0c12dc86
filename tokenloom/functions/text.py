"""Text expressions: hashes, embedding text, metadata, term lists."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TERM = r"([\p{L}\p{N}]+)"


def content_hash(text: Column | str) -> Column:
    """Lower-case hexadecimal SHA-256 of the UTF-8 text."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def embedding_text(title: Column, body: Column) -> Column:
    """What is embedded of a document: a short title is followed by the start of the body and the whole body."""
    short = F.concat(title, F.lit("\n"), F.substring(body, 1, 200), F.lit("\n"), body)
    return F.when(title.isNull(), body).when(F.char_length(title) >= 20, F.concat(title, F.lit("\n"), body)).otherwise(short)


def metadata_json(metadata: Column | str) -> Column:
    """JSON with sorted keys; empty text for an empty map."""
    return F.when(F.size(metadata) == 0, F.lit("")).otherwise(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(metadata)))))


def string_metadata(json: Column | str) -> Column:
    """map<string,string> of a JSON object's string members; other members, and what is no object, are left out."""
    members = F.from_json(json, "map<string,variant>")
    texts = F.map_filter(members, lambda k, v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform_values(texts, lambda k, v: F.variant_get(v, "$", "string")), F.create_map().cast("map<string,string>"))


def terms(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM))


def match_query(text: Column | str) -> Column:
    """A full-text query as quoted terms, all of which must match."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TERM)), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " ")


@F.pandas_udf(StringType())
def fold_accents(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text without combining marks: Spark has no built-in that strips accents."""
    for part in texts:
        yield part.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)))
