"""Sinks: rows of release files, and folders of one kind of file each."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith import schema
from vocalith.functions.values import file_row
from vocalith.schema import EXISTENTIAL, FILES, INFERRED
from vocalith.sources.archives import write_entries

#: Columns of the three files of a classification's results.
DELTA = ["id", "effectiveTime", "active", "moduleId", "sourceId", "destinationId", "relationshipGroup", "typeId", "characteristicTypeId", "modifierId"]
CONCRETE_DELTA = [c if c != "destinationId" else "value" for c in DELTA]
EQUIVALENTS = ["id", "effectiveTime", "active", "moduleId", "refsetId", "referencedComponentId", "mapTarget"]
AXIOM = ["id", "effectiveTime", "active", "moduleId", "refsetId", "referencedComponentId", "owlExpression"]


def relationship_rows(delta: DataFrame, concrete: bool = False) -> DataFrame:
    """row: added and moved relationships as active, removed ones as inactive; time and module stay empty."""
    chosen = delta.filter("value is not null" if concrete else "value is null")
    target = F.col("value") if concrete else F.col("destinationId")
    active = F.when(F.col("action") == "remove", "0").otherwise("1")
    blank = F.lit("")
    cells = [F.col("id"), blank, active, blank, F.col("sourceId"), target, F.col("grp"), F.col("typeId"), F.lit(INFERRED), F.lit(EXISTENTIAL)]
    return chosen.select(active.alias("active"), F.col("sourceId"), file_row(cells).alias("row"))


def equivalent_rows(sets: DataFrame) -> DataFrame:
    """row: a member of an equivalence set; ids follow from set and member, so that a retried task writes the same."""
    hex_ = F.md5(F.concat_ws("/", F.lit("equivalent"), F.col("set_id"), F.col("member")))
    part = lambda c, a, n: F.substring(c, a, n)
    uuid = lambda c: F.concat_ws("-", part(c, 1, 8), part(c, 9, 4), F.concat(F.lit("3"), part(c, 14, 3)), F.concat(F.lit("8"), part(c, 18, 3)), part(c, 21, 12))
    target = uuid(F.md5(F.concat_ws("/", F.lit("set"), F.col("set_id"))))
    blank = F.lit("")
    return sets.select("set_id", file_row([uuid(hex_), blank, F.lit("1"), blank, blank, F.col("member"), target]).alias("row"))


def axiom_rows(axioms: DataFrame, module: int | None = None) -> DataFrame:
    """component, row of (axiom_id, component, moduleId, axiom, active); ids that are missing follow from the text."""
    hex_ = F.md5(F.concat_ws("/", F.col("component"), F.col("axiom")))
    made = F.concat_ws("-", F.substring(hex_, 1, 8), F.substring(hex_, 9, 4), F.concat(F.lit("3"), F.substring(hex_, 14, 3)), F.concat(F.lit("8"), F.substring(hex_, 18, 3)), F.substring(hex_, 21, 12))
    owner = F.coalesce(F.lit(module).cast("long"), F.col("moduleId"))
    cells = [F.coalesce("axiom_id", made), F.lit(""), F.when(F.col("active"), "1").otherwise("0"), owner, F.lit(schema.AXIOM_REFSET), F.col("component"), F.col("axiom")]
    return axioms.select("component", file_row(cells).alias("row"))


def write_lines(rows: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None) -> None:
    """Text files of `row`, sorted over all files by `order`; the header is a file of its own, the first by name."""
    spark = rows.sparkSession
    ordered = rows.orderBy(*order) if order else rows
    ordered.select(F.col("row").alias("value")).write.mode("overwrite").text(f"{path}/rows")
    if columns:
        spark.createDataFrame([("\t".join(columns),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def write_results(result, path: str) -> None:
    """The three files of a classification, each a folder."""
    order = lambda df: df.withColumn("first_", F.col("active") == "0")
    write_lines(order(relationship_rows(result.delta)), f"{path}/relationship_delta", DELTA, ["first_", "sourceId", "row"])
    write_lines(order(relationship_rows(result.delta, concrete=True)), f"{path}/concrete_delta", CONCRETE_DELTA, ["first_", "sourceId", "row"])
    write_lines(equivalent_rows(result.equivalents), f"{path}/equivalent_concepts", EQUIVALENTS, ["set_id", "row"])


def write_archive(result, path: str, day: date | None = None) -> None:
    """The three files of a classification as entries of one zip file, named by the day."""
    day = f"{day or date.today():%Y%m%d}"
    head = lambda name, columns: (name, "\t".join(columns), -1)
    names = [
        f"RF2/{n}_{day}.txt"
        for n in ("sct2_Relationship_Delta_Classification", "sct2_RelationshipConcreteValues_Delta_Classification", "der2_sRefset_EquivalentConceptSimpleMapDelta_Classification")
    ]
    heads = result.delta.sparkSession.createDataFrame([head(n, c) for n, c in zip(names, (DELTA, CONCRETE_DELTA, EQUIVALENTS), strict=True)], "entry string, line string, first_ int")
    of = lambda df, name, first, key: df.select(F.lit(name).alias("entry"), F.col("row").alias("line"), first.alias("first_"), F.col(key).alias("key_"))
    retired = (F.col("active") == "0").cast("int")
    rows = (
        of(relationship_rows(result.delta), names[0], retired, "sourceId")
        .unionByName(of(relationship_rows(result.delta, concrete=True), names[1], retired, "sourceId"))
        .unionByName(of(equivalent_rows(result.equivalents), names[2], F.lit(0), "set_id"))
    )
    write_entries(rows.unionByName(heads.withColumn("key_", F.lit(None).cast("long"))), path, ["first_", "key_", "line"])


def write_extract_archive(parts: dict[str, DataFrame], path: str, day: date | None = None) -> None:
    """The raw rows of services.extract as entries of one zip file, with headers."""
    day, made = f"{day or date.today():%Y%m%d}", None
    for kind, rows in parts.items():
        names = schema.columns(kind)
        cells = [F.when(F.col(n), "1").otherwise("0") if n == "active" else F.col(n) for n in names]
        entry = F.lit(f"{FILES[kind][0].replace('(', '').split('|')[0].rstrip('_')}_Snapshot_{day}.txt")
        body = rows.select(entry.alias("entry"), file_row(cells).alias("line"), F.lit(0).alias("first_"), F.col("id").cast("string").alias("key_"))
        head = rows.sparkSession.createDataFrame([("\t".join(names), -1)], "line string, first_ int").select(entry.alias("entry"), "line", "first_", F.lit(None).cast("string").alias("key_"))
        both = head.unionByName(body)
        made = both if made is None else made.unionByName(both)
    write_entries(made, path, ["first_", "key_", "line"])


def write_extract(parts: dict[str, DataFrame], path: str) -> None:
    """The raw rows of services.extract as files with headers, a folder for each kind."""
    for kind, rows in parts.items():
        names = schema.columns(kind)
        cells = [F.when(F.col(n), "1").otherwise("0") if n == "active" else F.col(n) for n in names]
        write_lines(rows.select("id", file_row(cells).alias("row")), f"{path}/{kind}", names, ["id", "row"])


def write_document(document: DataFrame, path: str) -> None:
    """The document's lines in order: one file if the path ends in .owl or .ofn, else a folder of text files."""
    if path.endswith((".owl", ".ofn")):
        write_entries(document.select(F.lit("").alias("entry"), "line", "place"), path, ["place"], packed=False)
    else:
        document.orderBy("place").select("line").write.mode("overwrite").text(path)


def dialects(spark: SparkSession, path: str) -> dict[int, str]:
    """Dialects of language refsets from a file of `refset=dialect` lines; there are some dozens."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\d+)\s*=", 1).alias("k"), F.trim(F.regexp_extract("value", r"=(.*)$", 1)).alias("v"))
    return {int(r.k): r.v for r in rows.filter("k <> ''").collect()}
