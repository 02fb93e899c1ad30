"""An ontology from a release: its own axioms, those generated from stated relationships, annotations, the document."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith import schema
from vocalith.functions import axioms, values
from vocalith.operators import graph
from vocalith.schema import ANNOTATION_ATTRIBUTE, DATA_ATTRIBUTE, IS_A, MODEL_ATTRIBUTE, OBJECT_ATTRIBUTE
from vocalith.sources import releases
from vocalith.sources.releases import Release
from vocalith.sources.shared import stored

# Prefixes that every document has.
PREFIXES = {
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "xml": "http://www.w3.org/XML/1998/namespace",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
}
#: Dialects of two language refsets; others come from a file (sources.sinks.dialects).
DIALECTS = {900000000000509007: "us", 900000000000508004: "gb"}


def stated_is_a(release: Release) -> DataFrame:
    """(child, parent) among active concepts."""
    edges = release.stated.filter(F.col("typeId") == IS_A).select(F.col("sourceId").alias("child"), F.col("destinationId").alias("parent"))
    return edges.join(release.concepts.select(F.col("id").alias("child")), "child", "left_semi")


def below(spark: SparkSession, edges: DataFrame, root: int, max_depth: int = 30) -> DataFrame:
    """node: descendants of one concept; more than 30 levels are an error."""
    return graph.descendants(edges, spark.createDataFrame([(root,)], "node long"), max_depth)


def object_root(release: Release) -> int:
    """The root of object attributes: an older release has only the root of all attributes."""
    return MODEL_ATTRIBUTE if release.concepts.filter(F.col("id") == OBJECT_ATTRIBUTE).isEmpty() else OBJECT_ATTRIBUTE


def generated_axioms(spark: SparkSession, release: Release, subset: DataFrame | None = None) -> DataFrame:
    """(component, axiom) of stated relationships: sub-property axioms of attributes, class axioms of all others.

    Whatever is below the root of attributes has no class axiom, even if no sub-property axiom covers it.
    """
    edges = stored(stated_is_a(release), "stated-is-a")
    parts = []
    for root, kind in ((object_root(release), "SubObjectPropertyOf"), (DATA_ATTRIBUTE, "SubDataPropertyOf"), (ANNOTATION_ATTRIBUTE, "SubAnnotationPropertyOf")):
        inside = edges.join(below(spark, edges, root).withColumnRenamed("node", "child"), "child", "left_semi")
        if root == MODEL_ATTRIBUTE:  # its roots have class axioms
            inside = inside.filter(~F.col("child").isin(OBJECT_ATTRIBUTE, DATA_ATTRIBUTE))
        parts.append(axioms.sub_property_axioms(inside, kind))
    barred = below(spark, edges, MODEL_ATTRIBUTE).filter(~F.col("node").isin(OBJECT_ATTRIBUTE, DATA_ATTRIBUTE))
    rows = release.stated.select(
        F.col("sourceId").alias("conceptId"), F.col("relationshipGroup").alias("grp"), "typeId", "destinationId",
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("text"),
    )
    eligible = rows.join(barred.withColumnRenamed("node", "conceptId"), "conceptId", "left_anti").join(release.concepts.select(F.col("id").alias("conceptId")), "conceptId", "left_semi")
    defined = release.concepts.filter("defined").select(F.col("id").alias("conceptId"))
    parts.append(axioms.class_axioms(axioms.class_expressions(eligible, releases.content_ungrouped(spark, release)), defined))
    made = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    if subset is not None:
        made = made.join(subset.select(F.col("id").alias("conceptId")), "conceptId", "left_semi")
    return made.select(F.col("conceptId").alias("component"), "axiom").distinct()


def all_axioms(spark: SparkSession, release: Release) -> DataFrame:
    """(axiom_id, component, axiom) of active concepts; generated ones have their text as axiom_id."""
    text = F.replace("axiom", F.lit(f":{schema.LEGACY_ROLE_GROUP}"), F.lit(f":{schema.ROLE_GROUP}"))
    # identifiers are short everywhere, whatever form the release has
    own = release.axioms.select("axiom_id", "component", values.short_ids(text, releases.namespaces(release).get("", "")).alias("axiom"))
    own = own.join(release.concepts.select(F.col("id").alias("component")), "component", "left_semi").select("axiom_id", "component", "axiom")
    made = generated_axioms(spark, release).select(F.col("axiom").alias("axiom_id"), "component", "axiom")
    return stored(own.unionByName(made), "axioms")


def property_chains(normal: DataFrame) -> DataFrame:
    """(first, second, whole), transitive properties included."""
    return normal.filter("rule = 'chain'").select(F.col("a").alias("first"), F.col("b").alias("second"), F.col("c").alias("whole"))


def annotations(release: Release, dialects: Mapping[int, str] = DIALECTS) -> DataFrame:
    """(conceptId, line): labels of names; preferred and alternative labels of synonyms; definitions."""
    refsets = F.create_map(*[F.lit(x) for k, v in dialects.items() for x in (k, v)])
    marks = release.acceptability.withColumn("dialect", F.coalesce(F.try_element_at(refsets, F.col("refsetId")), F.lit("")))
    sets = lambda a: F.array_sort(F.collect_set(F.when(F.col("acceptabilityId") == a, F.struct("refsetId", "dialect"))))
    per = marks.groupBy(F.col("descriptionId").alias("id")).agg(sets(schema.PREFERRED).alias("preferred"), sets(schema.ACCEPTABLE).alias("acceptable"))
    rows = release.descriptions.join(per, "id", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    name = (
        F.when(F.col("typeId") == schema.FSN, "rdfs:label")
        .when((F.col("typeId") == schema.SYNONYM) & (size("preferred") > 0), "skos:prefLabel")
        .when(F.col("typeId") == schema.SYNONYM, "skos:altLabel")
        .when(F.col("typeId") == schema.TEXT_DEFINITION, "skos:definition")
    )
    # the refsets that decide: those that prefer the term, or for a synonym without any those that accept it
    chosen = F.when((F.col("typeId") == schema.SYNONYM) & (size("preferred") == 0), F.col("acceptable")).otherwise(F.col("preferred"))
    names = F.transform(F.coalesce(chosen, F.array()), lambda x: x["dialect"])
    fsn = F.col("typeId") == schema.FSN
    tag = F.when(fsn, F.col("languageCode")).otherwise(values.language_tag(F.col("languageCode"), F.size(names), names))
    term = F.replace(F.replace("term", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    line = F.concat(F.lit("AnnotationAssertion("), F.col("name"), F.lit(" :"), F.col("conceptId"), F.lit(' "'), term, F.lit('"@'), F.col("tag"), F.lit(")"))
    return rows.withColumns({"name": name, "tag": tag}).filter("name is not null").select("conceptId", F.when(fsn, F.col("term")).alias("label"), line.alias("line"))


def document(spark: SparkSession, release: Release, uri: str | None = None, version: str | None = None, labels: bool = False, prelude: str = "", dialects: Mapping[int, str] = DIALECTS) -> DataFrame:
    """(place, line): a functional-syntax document, in order of place.

    Entities are sorted by identifier as text. The lines of all sections are rows of one DataFrame; only prefixes and
    header are written by the driver.
    """
    every = all_axioms(spark, release)
    if every.isEmpty():
        raise ValueError("no stated relationships and no axioms are found")
    spaces = releases.namespaces(release)
    core = spaces.get("", "")
    extra = {p: i for p, i in spaces.items() if p and p not in PREFIXES}
    address = uri or releases.header(release)
    if not address:
        raise ValueError("the ontology has no address")
    head = [*(prelude.splitlines() + [""] if extra and prelude else []), *[f"Prefix({p}:=<{i}>)" for p, i in extra.items()], f"Prefix(:=<{core}>)", *[f"Prefix({p}:=<{i}>)" for p, i in PREFIXES.items()], "", "", f"Ontology(<{address}>"]
    head += [f"<{address}/version/{version}>", ""] if version else [""]
    logical = every.select("axiom").distinct()
    first = F.regexp_extract("axiom", r"^(\w+)\(", 1)
    subject = F.regexp_extract("axiom", r"^\w+\((?:ObjectPropertyChain\([^)]*\) )?:(\d+)", 1)
    section = F.when(first.isin("SubDataPropertyOf"), 1).when(first.isin("SubAnnotationPropertyOf"), 2).when(first.isin("SubClassOf", "EquivalentClasses"), 3).otherwise(0)
    logical = logical.select(section.alias("section"), subject.alias("id"), "axiom")
    # entities by the place in which they are named
    roles = logical.select(F.explode(F.regexp_extract_all("axiom", F.lit(r"ObjectSomeValuesFrom\(:(\d+)"), 1)).alias("id"))
    data = logical.select(F.explode(F.regexp_extract_all("axiom", F.lit(r"DataHasValue\(:(\d+)"), 1)).alias("id"))
    named = lambda n: logical.filter(F.col("section") == n).select(F.explode(F.regexp_extract_all("axiom", F.lit(r":(\d+)"), 1)).alias("id"))
    classes = named(3).join(roles, "id", "left_anti").join(data, "id", "left_anti").distinct()
    kinds = (("Class", classes), ("ObjectProperty", roles.unionByName(named(0)).distinct()), ("DataProperty", data.unionByName(named(1)).distinct()), ("AnnotationProperty", named(2).distinct()))
    rank = lambda *c: F.array(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in c])
    out = spark.createDataFrame([(f"{i:04d}", x) for i, x in enumerate(head)], "k string, line string").select(rank("0", F.col("k")).alias("place"), "line")
    for i, (kind, ids) in enumerate(kinds):
        lines = ids.select(rank("1", F.lit(i), F.col("id")).alias("place"), F.concat(F.lit(f"Declaration({kind}(:"), F.col("id"), F.lit("))")).alias("line"))
        out = out.unionByName(lines)
    notes = annotations(release, dialects).withColumn("id", F.col("conceptId").cast("string")) if labels else None
    if notes is not None:
        used = notes.select(F.regexp_extract("line", r"\((skos:\w+)", 1).alias("id")).filter("id <> ''").distinct()
        out = out.unionByName(used.select(rank("1", F.lit(4), F.col("id")).alias("place"), F.concat(F.lit("Declaration(AnnotationProperty("), F.col("id"), F.lit("))")).alias("line")))
        label = notes.groupBy("id").agg(F.max("label").alias("label"))
    for n, (title, name) in enumerate((("Object Properties", "Object Property"), ("Data Properties", "Data Property"), ("Annotation Properties", "Annotation Property"), ("Classes", "Class"))):
        mine = logical.filter(F.col("section") == n).filter("id <> ''")
        if mine.isEmpty():
            continue
        at = lambda *c: rank("2", F.lit(n), *c)  # noqa: B023, E731
        bar = "#" * 28
        frame = spark.createDataFrame([("0", x) for x in ("", bar, f"#   {title}", bar, "")], "a string, line string").withColumn("i", F.monotonically_increasing_id())
        out = out.unionByName(frame.select(at(F.lit(""), F.lit("0"), F.lpad(F.col("i").cast("string"), 12, "0")).alias("place"), "line"))
        ids = mine.select("id").distinct() if n != 3 else classes
        iri = F.concat(F.lit(f"<{core}"), F.col("id"), F.lit(">"))
        entity = ids.join(label, "id", "left") if notes is not None else ids.withColumn("label", F.lit(None).cast("string"))
        shown = entity.join((mine.select("id").unionByName(notes.select("id")) if notes is not None else mine.select("id")).distinct(), "id", "left_semi")
        title_line = F.concat(F.lit(f"# {name}: "), iri, F.lit(" ("), F.coalesce("label", iri), F.lit(")"))
        out = out.unionByName(shown.select(at(F.col("id"), F.lit("1"), F.lit("")).alias("place"), F.explode(F.array(title_line, F.lit(""))).alias("line")))
        if notes is not None:
            out = out.unionByName(notes.join(ids, "id", "left_semi").select(at(F.col("id"), F.lit("2"), F.col("line")).alias("place"), "line"))
        out = out.unionByName(mine.select(at(F.col("id"), F.lit("3"), F.col("axiom")).alias("place"), F.col("axiom").alias("line")))
        out = out.unionByName(shown.select(at(F.col("id"), F.lit("4"), F.lit("")).alias("place"), F.lit("").alias("line")))
    tail = spark.createDataFrame([("3", ""), ("4", ")")], "k string, line string").select(rank(F.col("k")).alias("place"), "line")
    return out.unionByName(tail)
