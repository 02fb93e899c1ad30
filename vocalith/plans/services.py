"""Services over releases: classify, render, convert, reconcile, extract."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith import schema
from vocalith.functions import axioms as ax
from vocalith.functions import values
from vocalith.operators import classify as el
from vocalith.operators import diff, graph, normal_form, state
from vocalith.plans import ontology
from vocalith.schema import IS_A
from vocalith.sources import releases, sinks
from vocalith.sources.releases import Release
from vocalith.sources.shared import stored

#: Reasoners by name: normalised axioms to strict subsumption among named concepts.
REASONERS: dict[str, Callable[[DataFrame], DataFrame]] = {"el": el.saturate}


@dataclass
class Classification:
    delta: DataFrame  # action, id, sourceId, grp, typeId, destinationId, value, universal, inactivated
    equivalents: DataFrame  # set_id, member
    parents: DataFrame  # child, parent
    axioms: DataFrame
    counts: dict[str, int]  # added, moved, removed, inactivated


def classify(spark: SparkSession, snapshots: Sequence[str], delta: str | None = None, reasoner: str = "el", today: int | None = None) -> Classification:
    infer = REASONERS[reasoner]  # an unknown name fails before anything is read
    return classify_release(spark, releases.load(spark, snapshots, delta, today=today), infer)


def classify_release(spark: SparkSession, release: Release, infer: Callable[[DataFrame], DataFrame] = el.saturate) -> Classification:
    every = ontology.all_axioms(spark, release)
    normal = stored(ax.normalised(every), "normal")
    ax.check_names(normal)
    # one of those that are told to be the same stands for all, and one of the leaves with the same parents
    rules, leaves = el.shared_leaves(normal) if infer is el.saturate else (normal, None)
    subsumed, same_as = el.saturated(rules) if infer is el.saturate else (infer(rules), None)
    parents, sets, strict = el.taxonomy(subsumed, release.concepts, same_as, leaves)
    roles = normal.filter("rule = 'role'").select(F.col("a").alias("child"), F.col("b").alias("parent")).distinct()
    parents = stored(parents.unionByName(roles).distinct(), "parents")
    attributes = roles.select(F.col("child").alias("node")).unionByName(roles.select(F.col("parent").alias("node"))).distinct()
    node = _walked(normal)
    same = lambda df: df.select(F.col("node").alias("child"), F.col("node").alias("ancestor"))
    types = graph.closure(roles).unionByName(same(attributes)).distinct()
    # what is inactive or an attribute has none
    walked_ids = node.withColumnRenamed("node", "conceptId")
    own = own_attributes(release, every).join(walked_ids, "conceptId", "left_semi").join(attributes.withColumnRenamed("node", "conceptId"), "conceptId", "left_anti")
    # rows are compared by their destinations alone
    is_a = stored(_among(own.select(F.col("destinationId").alias("node")).filter("node is not null").distinct(), strict, sets), "is-a")
    nf = normal_form.inferred_attributes(own, parents, types, is_a, stored(ontology.property_chains(normal), "chains"))
    published = normal_form.with_universal(release.inferred).select(
        "id", "moduleId", F.col("sourceId"), *normal_form.ROW, F.col("relationshipGroup").alias("grp")
    )
    before = published.filter(F.col("typeId") != IS_A).select(F.col("sourceId").alias("conceptId"), "grp", *normal_form.ROW, "moduleId")
    nf = stored(normal_form.stable_numbers(nf, before), "normal-form")
    new = parents.select(
        F.col("child").alias("sourceId"), F.lit(0).alias("grp"), F.lit(IS_A).cast("long").alias("typeId"), F.col("parent").alias("destinationId"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("universal")
    ).unionByName(nf.withColumnRenamed("conceptId", "sourceId"))
    # what is not walked stays as published, and what is inactivated goes altogether
    walked = published.join(node.withColumnRenamed("node", "sourceId"), "sourceId", "left_semi")
    changes = diff.compare(walked, new, "sourceId", normal_form.ROW, "grp", IS_A)
    dead = release.inactive.select(F.col("id").alias("sourceId"))
    changes = changes.withColumn("inactivated", F.lit(False))
    gone = state.retired(published, "sourceId", dead).select(F.lit("remove").alias("action"), "id", "sourceId", *normal_form.ROW, "grp", F.lit(True).alias("inactivated"))
    kept = changes.filter("action <> 'remove'").unionByName(changes.filter("action = 'remove'").join(dead, "sourceId", "left_anti").select(changes.columns))
    delta, counts = diff.counted(reuse(kept.unionByName(gone.select(changes.columns)), release.pool))
    return Classification(stored(delta, "delta"), sets, parents, every, counts.get)


def _walked(normal: DataFrame) -> DataFrame:
    """node: named classes, and attributes that have a place among the attributes; roles alone are no classes."""
    of = lambda rules, c: normal.filter(F.col("rule").isin(*rules)).select(F.col(c).alias("node"))
    named = of(("told", "member", "role"), "a").unionByName(of(("told", "role"), "b")).unionByName(of(("exists",), "c"))
    return named.filter("node > 0").distinct()


def _among(nodes: DataFrame, strict: DataFrame, sets: DataFrame) -> DataFrame:
    """(child, ancestor) of these nodes alone, members of equivalence sets included; each is below itself."""
    named = nodes.join(sets.withColumnRenamed("member", "node"), "node", "left").select("node", F.coalesce("set_id", "node").alias("rep"))
    low, high = named.select(F.col("rep").alias("child"), F.col("node").alias("low")), named.select(F.col("rep").alias("ancestor"), F.col("node").alias("high"))
    below = strict.join(low, "child").join(high, "ancestor").select(F.col("low").alias("child"), F.col("high").alias("ancestor"))
    return below.unionByName(low.join(high, F.col("child") == F.col("ancestor")).select(F.col("low").alias("child"), F.col("high").alias("ancestor")))


def own_attributes(release: Release, every: DataFrame) -> DataFrame:
    """(conceptId, grp, typeId, destinationId, value, universal): stated attributes, and those of axioms about their own component."""
    stated = normal_form.with_universal(release.stated).filter(F.col("typeId") != IS_A).select(
        F.col("sourceId").alias("conceptId"), F.col("relationshipGroup").alias("grp"), "typeId", "destinationId", F.lit(None).cast("string").alias("value"), "universal"
    )
    rows = ax.relationships(every.join(release.axioms.select("axiom_id"), "axiom_id", "left_semi"), skip_gci=True)
    if not (bad := rows.filter("error is not null").select("axiom_id", "error").limit(1).collect()) == []:
        raise ValueError(f"axiom {bad[0].axiom_id}: {bad[0].error}")
    mine = rows.filter("side = 'right' and left_concept = component").filter(F.col("typeId") != IS_A).select(
        F.col("left_concept").alias("conceptId"), "grp", "typeId", "destinationId",
        F.when(F.col("text").isNotNull(), values.concrete_text(F.col("kind"), F.col("text"))).alias("value"), F.lit(False).alias("universal"),
    )
    return stored(stated.unionByName(mine).distinct(), "own")


def reuse(delta: DataFrame, pool: DataFrame) -> DataFrame:
    """Added rows take the id of the latest retired row with the same source, group, type and destination."""
    keys = ["sourceId", "grp", "typeId", "destinationId"]
    old = pool.select("id", "effectiveTime", "sourceId", F.col("relationshipGroup").alias("grp"), "typeId", "destinationId")
    added = diff.reuse_ids(delta.filter("action = 'add'"), old, keys)
    again = added.withColumn("id", F.coalesce("id", "reused_id")).select(delta.columns)
    return delta.filter("action <> 'add'").unionByName(again)


def to_owl(spark: SparkSession, snapshots: Sequence[str], delta: str | None = None, uri: str | None = None, version: str | None = None, labels: bool = True, prelude: str = "", dialects=ontology.DIALECTS) -> DataFrame:
    release = releases.load(spark, snapshots, delta, "language" if labels else "base")
    return ontology.document(spark, release, uri, version, labels, prelude, dialects)


def _rows(release: Release, made: DataFrame) -> DataFrame:
    """Generated axioms in the module of their concept."""
    modules = release.modules.select(F.col("id").alias("component"), "moduleId")
    return made.join(modules, "component", "left").select(F.lit(None).cast("string").alias("axiom_id"), "component", "moduleId", "axiom", F.lit(True).alias("active"))


def stated_to_owl(spark: SparkSession, snapshot: str, delta: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(stated rows to retire, axiom rows) of an international release: (sourceId or component, row).

    Delta axioms are copied as they are, before the generated ones.
    """
    release = releases.load(spark, [snapshot], delta)
    old = release.raw["old_stated"].filter("active").filter(F.col("characteristicTypeId") == schema.STATED)
    copied = release.raw["new_axiom"].select(F.lit(0).alias("part"), F.col("referencedComponentId").alias("component"), _axiom_copy().alias("row"))
    made = sinks.axiom_rows(_rows(release, ontology.generated_axioms(spark, release))).select(F.lit(1).alias("part"), "component", "row")
    return retirements(old), copied.unionByName(made)


def _axiom_copy():
    return values.file_row([F.col("id"), F.lit(""), F.when(F.col("active"), "1").otherwise("0"), F.col("moduleId"), F.col("refsetId"), F.col("referencedComponentId"), F.col("owlExpression")])


def retirements(rows: DataFrame, active: str = "0") -> DataFrame:
    """(sourceId, id, row): stated rows with the flag and without a time."""
    cells = [F.col("id"), F.lit(""), F.lit(active), *[F.col(c) for c in ("moduleId", "sourceId", "destinationId", "relationshipGroup", "typeId", "characteristicTypeId", "modifierId")]]
    return rows.select("sourceId", "id", values.file_row(cells).alias("row"))


def stated_to_owl_extension(spark: SparkSession, international: str, extension: str, delta: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(axiom rows, stated rows to retire, stated rows that stay) of an extension on top of an international release."""
    both, base = releases.load(spark, [international, extension], delta), releases.load(spark, [international])
    own = both.concepts.select("id").join(both.inactive, "id", "left_anti").join(base.concepts.select("id"), "id", "left_anti")
    module = both.concepts.filter(~F.col("moduleId").isin(*schema.INTERNATIONAL_MODULES)).agg(F.min_by("moduleId", "id")).first()[0]
    made = sinks.axiom_rows(_rows(both, ontology.generated_axioms(spark, both, own)), module)
    named = own.withColumnRenamed("id", "sourceId")
    stated = both.stated.join(named, "sourceId", "left_semi")
    extra = both.raw["old_stated"].join(base.concepts.select(F.col("id").alias("sourceId")), "sourceId", "left_semi").filter("active").filter(~F.col("moduleId").isin(*schema.INTERNATIONAL_MODULES))
    return made, retirements(stated), retirements(extra, "1")


def reconcile(spark: SparkSession, authoring: str, delta: str | None, published: str) -> DataFrame:
    """(component, row): axioms of a mid-cycle release that are new, modified, retired or active again against published ones."""
    now, old = releases.load(spark, [authoring], delta), releases.load(spark, [published], profile="owl")
    made = ontology.generated_axioms(spark, now)
    known = old.axioms.join(now.axioms.select("axiom_id"), "axiom_id", "left_anti")
    first = known.groupBy("component").agg(F.min_by(F.struct("axiom_id", "axiom", "moduleId"), "axiom_id").alias("p"))
    mine = made.groupBy("component").agg(F.min("axiom").alias("axiom"))
    told = diff.reconcile(first.select("component", F.col("p.axiom").alias("axiom")), mine, "component", "axiom")
    compared = told.filter("status in ('new', 'modified')").select("component", F.col("current").alias("axiom")).join(first, "component", "left")
    modules = now.modules.select(F.col("id").alias("component"), "moduleId")
    changed = compared.join(modules, "component", "left").select(F.col("p.axiom_id").alias("axiom_id"), "component", "moduleId", "axiom", F.lit(True).alias("active"))
    gone, back = state.newly_inactive(old.inactive, now.inactive)
    flip = lambda ids, flag: known.join(ids.select(F.col("id").alias("component")), "component", "left_semi").select("axiom_id", "component", "moduleId", "axiom", F.lit(flag).alias("active"))
    rest = changed.join(gone.select(F.col("id").alias("component")), "component", "left_anti")
    return sinks.axiom_rows(rest.unionByName(flip(gone, False)).unionByName(flip(back, True)))


#: The one id of all rows made from axioms, which are for statistics.
STATED_ID = 1_000_000_020


def axioms_to_stated(spark: SparkSession, snapshots: Sequence[str], delta: str | None = None) -> DataFrame:
    """(sourceId, grp, place, row): stated rows of all axioms about their own component, for statistics.

    Groups of a concept's axioms follow each other; group 0 is shared.  A concrete value has the destination -1, and the
    row ends with a tab.  ValueError if an axiom can't be converted.
    """
    release = releases.load(spark, snapshots, delta)
    converted = stored(ax.relationships(release.axioms), "axiom-rows")
    if bad := converted.filter("error is not null").select("axiom_id", "error").limit(1).collect():
        raise ValueError(f"axiom {bad[0].axiom_id}: {bad[0].error}")
    modules = release.modules.select(F.col("id").alias("left_concept"), "moduleId")
    rows = converted.filter("side = 'right' and left_concept = component").join(modules, "left_concept", "left")
    cells = [
        F.lit(STATED_ID), F.lit(""), F.lit("1"), F.col("moduleId"), F.col("left_concept"), F.coalesce("destinationId", F.lit(-1)), F.col("grp"), F.col("typeId"),
        F.lit(schema.STATED), F.lit(schema.EXISTENTIAL), F.lit(""),
    ]
    place = F.struct("axiom_id", "ord")
    return rows.select(F.col("left_concept").alias("sourceId"), "grp", place.alias("place"), values.file_row(cells).alias("row"))


def extract(spark: SparkSession, snapshots: Sequence[str], concepts: DataFrame) -> dict[str, DataFrame]:
    """Raw rows of a subset of concepts (id): concepts, descriptions, their language rows, and axioms."""
    raw = releases.read_raw(spark, snapshots, "language")
    ids = concepts.select("id").distinct()
    of = lambda kind, c: raw[kind].join(ids.withColumnRenamed("id", c), c, "left_semi").select(raw[kind].columns)
    descriptions = of("description", "conceptId")
    language = raw["language"].join(descriptions.select(F.col("id").alias("referencedComponentId")), "referencedComponentId", "left_semi").select(raw["language"].columns)
    return {"concept": of("concept", "id"), "description": descriptions, "language": language, "axiom": of("axiom", "referencedComponentId")}
