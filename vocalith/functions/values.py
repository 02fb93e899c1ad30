"""Column expressions for concrete values, identifiers in axiom texts, annotations and file rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def concrete(text: Column) -> Column:
    """struct(kind, text): `#` starts a number, DECIMAL if it has a point; else STRING, without one quote at either end."""
    number = F.startswith(text, F.lit("#"))
    bare = F.regexp_replace(F.regexp_replace(text, '^"', ""), '"$', "")
    kind = F.when(number & F.contains(text, F.lit(".")), "DECIMAL").when(number, "INTEGER").otherwise("STRING")
    return F.when(text.isNotNull(), F.struct(kind.alias("kind"), F.when(number, F.substr(text, F.lit(2))).otherwise(bare).alias("text")))


def concrete_text(kind: Column, text: Column) -> Column:
    """The file's form of a value."""
    return F.when(kind == "STRING", F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("#"), text))


def literal(kind: Column, text: Column) -> Column:
    """The axiom's form of a value."""
    name = F.lower(kind)
    return F.concat(F.lit('"'), text, F.lit('"^^xsd:'), name)


def signature(expression: Column) -> Column:
    """Distinct identifiers that an axiom names."""
    return F.transform(F.array_distinct(F.regexp_extract_all(expression, F.lit(":([0-9]+)"), 1)), lambda x: x.cast("long"))


def short_ids(expression: Column, core: str) -> Column:
    """Full identifiers of the core namespace in their short form."""
    return F.regexp_replace(expression, f"<{re.escape(core)}([0-9]+)>", r":$1") if core else expression


def property_flags(expression: Column) -> list[Column]:
    """transitive, reflexive, chain: characteristics that an object-property axiom states."""
    return [
        F.startswith(expression, F.lit("TransitiveObjectProperty(")).alias("transitive"),
        F.startswith(expression, F.lit("ReflexiveObjectProperty(")).alias("reflexive"),
        F.rlike(expression, F.lit(r"^SubObjectPropertyOf\s*\(\s*ObjectPropertyChain")).alias("chain"),
    ]


def language_tag(language: Column, preferred: Column, dialects: Column) -> Column:
    """language-dialect where exactly one refset prefers the term and has a dialect. dialects: array of suffixes."""
    return F.when((preferred == 1) & (F.size(dialects) == 1) & (F.element_at(dialects, 1) != ""), F.concat_ws("-", language, F.element_at(dialects, 1))).otherwise(language)


def file_row(columns: Sequence[Column]) -> Column:
    """A row of a release file: empty for null, tabs between."""
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
