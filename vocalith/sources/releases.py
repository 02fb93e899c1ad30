"""Release archives as DataFrames: folders or zip files of tab-separated rows, snapshots and an optional delta.

Folders are read by Spark's text source, which opens the files of a kind by their names and splits them like any text.
The entries of a zip file are partitions (archives); those of the profile's kinds are inflated, once.  Only line feeds end a line.  Rows are
typed by position, comment and header lines go.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalith import schema
from vocalith.operators import state
from vocalith.schema import ADDITIONAL, FILES, HEADER_ROW, IS_A, NAMESPACE_ROW, PROFILES, UNIVERSAL
from vocalith.sources.archives import archive_lines
from vocalith.sources.shared import stored


def named(kind: str) -> str:
    """The glob of a kind's file names."""
    return FILES[kind][0].replace("(", "{").replace("|", ",").replace(")", "}") + "*"


def folder_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """line, of the files of one kind in a folder; other files aren't opened."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", named(kind)).option("lineSep", "\n").text(path)
    return rows.select(F.regexp_replace("value", "\r$", "").alias("line"))


def typed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind of file (line) with typed columns; blank is null, and active only "1"."""
    cells = F.split("line", "\t", -1)

    def cell(i: int, name: str, kind_: T.DataType):
        x = F.nullif(F.get(cells, F.lit(i)), F.lit(""))
        return (F.coalesce(x, F.lit("")) == "1" if isinstance(kind_, T.BooleanType) else x.try_cast(kind_)).alias(name)

    data = rows.filter(~F.rlike("line", F.lit(r"^(#|id\t|\s*$)")))
    return data.select(*[cell(i, n, k) for i, (n, k) in enumerate(FILES[kind][1])])


def read_raw(spark: SparkSession, paths: Sequence[str], profile: str = "base") -> dict[str, DataFrame]:
    """Rows of each kind from all archives together."""
    kinds = PROFILES[profile]
    if not paths:
        return {k: spark.createDataFrame([], schema.struct(k)) for k in kinds}
    # an archive is inflated once, all its entries beside each other; a file of the table has one kind, so a filter skips
    # the others, and no task sorts an entry by kind, as folders would have it
    zips = {p: stored(archive_lines(spark, p, {k: FILES[k][0] for k in kinds}), "archive") for p in paths if p.endswith(".zip")}
    of = lambda p, k: zips[p].filter(F.col("kind") == k).select("line") if p in zips else folder_lines(spark, p, k)
    return {k: typed(reduce(DataFrame.unionByName, [of(p, k) for p in paths]), k) for k in kinds}


@dataclass
class Release:
    """The state of a terminology: what is active, what was retired, and what may be reused."""

    concepts: DataFrame  # id, moduleId, defined
    inactive: DataFrame  # id, owners that only relationships name included
    modules: DataFrame  # id, moduleId of all concepts
    stated: DataFrame  # relationships as in the file, active; universal: all values are meant, not some
    inferred: DataFrame  # as stated, with value; destinationId is null for concrete ones
    pool: DataFrame  # retired inferred relationships
    axioms: DataFrame  # axiom_id, component, moduleId, axiom
    ontology: DataFrame  # id, row (namespace or header), text
    ungrouped: DataFrame  # contentTypeId, attributeId
    descriptions: DataFrame | None = None
    acceptability: DataFrame | None = None  # descriptionId, refsetId, acceptabilityId
    raw: dict[str, DataFrame] = field(default_factory=dict)


def load(spark: SparkSession, snapshots: Sequence[str], delta: str | None = None, profile: str = "base", today: int | None = None) -> Release:
    """The effective snapshot of all archives with a delta on top. A row without a time counts as of `today`, the day of the load."""
    old, new = read_raw(spark, snapshots, profile), read_raw(spark, [delta] if delta else [], profile)
    return merge(spark, old, new, today)


def merge(spark: SparkSession, old: dict[str, DataFrame], new: dict[str, DataFrame], today: int | None = None) -> Release:
    today = today or int(f"{date.today():%Y%m%d}")

    def ranked(kind: str) -> DataFrame:
        mark = lambda df, r: df.withColumn("source_rank", F.lit(r)).withColumn("effectiveTime", F.coalesce("effectiveTime", F.lit(today)))
        if kind not in old:
            return mark(spark.createDataFrame([], schema.struct(kind)), 0)
        return mark(old[kind], 0).unionByName(mark(new[kind], 1))

    # of equal times the active row counts, and then the higher module
    order = [F.col("source_rank"), F.col("effectiveTime"), F.col("active"), F.col("moduleId")]
    last = lambda kind, *keys: state.latest_state(ranked(kind), keys or ("id",), order)

    # states are merged once, and not again by each of the services' joins
    concept = stored(last("concept"), "concepts")
    active = concept.filter("active").select("id", "moduleId", (F.col("definitionStatusId") == schema.DEFINED).alias("defined"))
    edges = ranked("relationship")
    stated_rows = ranked("stated").unionByName(edges.filter(F.col("characteristicTypeId") == schema.STATED))
    edges = edges.filter(F.col("characteristicTypeId") != schema.STATED)
    plain = F.col("characteristicTypeId") != ADDITIONAL
    universal = F.coalesce(F.col("modifierId") == UNIVERSAL, F.lit(False))
    stated = stored(state.latest_state(stated_rows, ["id"], order).filter("active").filter(plain), "stated")
    inferred = state.latest_state(edges, ["id"], order).filter("active").filter(plain).withColumn("value", F.lit(None).cast("string"))
    concrete = last("concrete").filter("active").withColumn("destinationId", F.lit(None).cast("long"))
    inferred = stored(inferred.unionByName(concrete).withColumn("universal", universal), "inferred")
    pool = edges.filter(~F.col("active") | ~plain)
    named = stated_rows.select("sourceId").unionByName(edges.select("sourceId")).unionByName(ranked("concrete").select("sourceId"))
    orphaned = state.orphans(named, "sourceId", active.select(F.col("id").alias("sourceId")), "sourceId").select(F.col("sourceId").alias("id"))
    inactive = stored(concept.filter("not active").select("id").unionByName(orphaned).distinct(), "inactive")
    axioms = last("axiom", "referencedComponentId", "id").filter("active")
    roles = last("mrcm").filter("active and grouped = '0'")
    release = Release(
        concepts=active, inactive=inactive, modules=concept.select("id", "moduleId"), stated=stated.withColumn("universal", universal),
        inferred=inferred, pool=pool,
        axioms=axioms.select(F.col("id").alias("axiom_id"), F.col("referencedComponentId").alias("component"), "moduleId", F.col("owlExpression").alias("axiom")),
        ontology=last("ontology").filter("active").select("id", F.col("referencedComponentId").alias("row"), F.col("owlExpression").alias("text")),
        ungrouped=roles.select("contentTypeId", F.col("referencedComponentId").alias("attributeId")).distinct(),
        raw={"old_" + k: v for k, v in old.items()} | {"new_" + k: v for k, v in new.items()},
    )
    if "description" in old:
        release.descriptions = last("description").filter("active").select("id", "conceptId", "languageCode", "typeId", "term")
        language = state.latest_state(ranked("language"), ["id"], order).filter("active")
        release.acceptability = language.select(F.col("referencedComponentId").alias("descriptionId"), "refsetId", "acceptabilityId").distinct()
    return release


def content_ungrouped(spark: SparkSession, release: Release, content: int = schema.ALL_CONTENT) -> DataFrame:
    """attributeId: roles that are never grouped in a type of content."""
    children = release.inferred.filter(F.col("typeId") == IS_A).select(F.col("destinationId").alias("parent"), F.col("sourceId").alias("child"))
    types = spark.createDataFrame([(content,)], "contentTypeId long")
    return state.ungrouped_roles(release.ungrouped, children, types, schema.DEFAULT_UNGROUPED).select("attributeId").distinct()


def namespaces(release: Release) -> dict[str, str]:
    """Prefixes of the release's ontology rows; a release has a handful."""
    rows = release.ontology.filter(F.col("row") == NAMESPACE_ROW).select(
        F.regexp_extract("text", r"Prefix\((\S*):=<", 1).alias("p"), F.regexp_extract("text", r":=<([^>]*)>", 1).alias("iri")
    )
    return {r.p: r.iri for r in rows.orderBy("p").collect()}


def header(release: Release) -> str | None:
    """The ontology's address from its one header row; ValueError if there are several or it has another form."""
    rows = release.ontology.filter(F.col("row") == HEADER_ROW).select("text").limit(2).collect()
    if not rows:
        return None
    import re

    m = re.fullmatch(r"Ontology\(<([^>]*)>\)?", rows[0].text.strip())
    if len(rows) > 1 or not m:
        raise ValueError("one ontology header of the form Ontology(<address>) is expected")
    return m[1]
