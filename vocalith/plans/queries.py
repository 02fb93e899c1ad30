"""Queries over the driver's tables, one for each operator, with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.functions import axioms, values
from vocalith.operators import classify, diff, graph, groups, identifiers, normal_form, state
from vocalith.plans import ontology, services
from vocalith.plans import tables as t
from vocalith.plans.tables import is_a, table
from vocalith.schema import CORE_MODULE, DEFAULT_UNGROUPED, DEFINED, EXISTENTIAL, INFERRED, IS_A, MODEL_ATTRIBUTE, OBJECT_ATTRIBUTE, PRIMITIVE, STATED
from vocalith.sources.archives import write_entries
from vocalith.sources.releases import Release, read_raw
from vocalith.sources.shared import fresh_path, stored
from vocalith.streaming import overlay

#: Dates that split orders into a snapshot and a delta.
CUTOFF = "1997-01-01"
#: Added to a place's number for the class of what is located there.
LOCAL = 500_000_000
#: An attribute of this terminology.
MARKET = 900
long = "bigint"


def _long(name: str, plus: int = 0):
    return (F.col(name) + F.lit(plus)).cast(long)


# -- state ------------------------------------------------------------------------------------------------------------


def latest_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return state.latest_state(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


def streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from a stream: files of events arrive in any order, and each is merged into the states so far."""
    rows, top = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), fresh_path(spark, "stream")
    rows.repartitionByRange(4, "event_id").write.parquet(f"{top}/feed")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/feed")
    overlay.apply_deltas(stream, f"{top}/changes", ["user_id"], ["ts", "event_id"], f"{top}/checkpoint").awaitTermination()
    return overlay.states(spark, f"{top}/checkpoint", stream.columns, ["user_id"]).select("user_id", "event_id", "event_type", "value")


def snapshot_delta_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    old, new = rows.filter(F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz")), rows.filter(F.col("o_orderdate") >= F.lit(CUTOFF).cast("timestamp_ntz"))
    merged = state.overlay(old, new, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return merged.filter(F.col("o_orderstatus") != "F").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("source_rank").cast(long).alias("source_rank"))


def definition_status_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(_long("p_partkey", t.PART).alias("concept_id"), (F.col("p_size") >= 25).alias("defined"), (F.col("p_size") < 25).alias("primitive"))


def orphan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.orphans(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")


def relationship_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") != "A").select(
        _long("l_orderkey", t.ORDER).alias("source_id"), _long("l_suppkey", t.SUPPLIER).alias("destination_id"),
        F.col("l_linenumber").cast(long).alias("relationship_group"),
        (F.col("l_linestatus") == "O").alias("stated"), (F.col("l_returnflag") == "R").alias("universal"),
    )


def concrete_value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    texts = F.array(F.concat(F.lit("#"), F.col("p_size")), F.concat(F.lit("#"), F.col("p_size"), F.lit(".50")), F.concat(F.lit('"'), F.col("p_brand"), F.lit('"')))
    rows = part.select(_long("p_partkey", t.PART).alias("concept_id"), F.posexplode(texts).alias("pos", "value"))
    parsed = rows.withColumn("v", values.concrete(F.col("value")))
    return parsed.select("concept_id", F.col("pos").cast(long).alias("pos"), "value", F.col("v.kind").alias("kind"), F.col("v.text").alias("text"), values.concrete_text(F.col("v.kind"), F.col("v.text")).alias("rendered"))


def ungrouped_roles_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content types are nations and customers; roles are priorities of customers' open orders; customers are children."""
    code = F.substring("o_orderpriority", 1, 1).cast(long)
    roles = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(_long("o_custkey", t.CUSTOMER).alias("contentTypeId"), code.alias("attributeId")).distinct()
    children = table(spark, sf_dir, "customer").select(_long("c_nationkey", t.NATION).alias("parent"), _long("c_custkey", t.CUSTOMER).alias("child"))
    types = children.select(F.col("parent").alias("contentTypeId")).unionByName(children.select(F.col("child").alias("contentTypeId"))).distinct()
    found = state.ungrouped_roles(roles, children, types, DEFAULT_UNGROUPED)
    return found.select(F.col("contentTypeId").alias("content_type_id"), F.col("attributeId").alias("attribute_id"))


def inactivation_retirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    europe = table(spark, sf_dir, "region").filter("r_name = 'EUROPE'").select(F.col("r_regionkey").alias("n_regionkey"))
    gone = table(spark, sf_dir, "nation").join(europe, "n_regionkey", "left_semi").select("n_nationkey")
    return state.retired(customer, "c_nationkey", gone).select("c_custkey", F.col("c_nationkey").cast(long).alias("c_nationkey"), "c_mktsegment")


# -- hierarchies --------------------------------------------------------------------------------------------------------


def stated_isa_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(is_a(spark, sf_dir))


def descendants_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = table(spark, sf_dir, "region").filter("r_regionkey = 1").select(_long("r_regionkey", t.REGION).alias("node"))
    return graph.descendants(is_a(spark, sf_dir), root)


def _with_shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are also filed under their region directly."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    direct = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return is_a(spark, sf_dir).unionByName(direct.select(_long("c_custkey", t.CUSTOMER).alias("child"), _long("n_regionkey", t.REGION).alias("parent")))


def direct_parents_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _with_shortcuts(spark, sf_dir)
    return graph.direct_parents(graph.closure(edges), edges)


def hierarchy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(_with_shortcuts(spark, sf_dir)).select("node", F.col("level").cast(long).alias("level"))


def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of urgent orders lead to the customer of the next such order of 25; who reaches each other is one set."""
    some = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus <> 'F'").select("o_orderkey", _long("o_custkey", t.CUSTOMER).alias("child"))
    numbered = identifiers.dense_numbers(some, ["o_orderkey"], "n")
    after = numbered.select((F.col("n") - 1).alias("n"), F.col("child").alias("parent"))
    return graph.strong_components(numbered.join(after, "n").filter("n % 25 <> 0").select("child", "parent"))


def numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have no clerk's number get the next ones: by date and key, behind a supplier that adds a check digit."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") * 10).cast(long).alias("id"))
    return identifiers.supplied(orders, "id", ["o_orderdate", "o_orderkey"], lambda n: -(n * 10 + n % 7)).select("o_orderkey", "id")


def equivalent_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders of one priority and status subsume their neighbours by number, both ways; so the set is one class."""
    ordered = Window.partitionBy("o_custkey", "o_orderpriority", "o_orderstatus").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("before", F.lag("o_orderkey").over(ordered)).filter("before is not null")
    up = orders.select(_long("o_orderkey", t.ORDER).alias("child"), _long("before", t.ORDER).alias("parent"))
    both = up.unionByName(up.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
    return graph.equivalents(graph.closure(both).filter("child <> ancestor"))


def inherited_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations have attributes; all below inherit them."""
    region = table(spark, sf_dir, "region").select(_long("r_regionkey", t.REGION).alias("concept_id"), F.col("r_name").alias("attribute"))
    nation = table(spark, sf_dir, "nation").select(_long("n_nationkey", t.NATION).alias("concept_id"), F.col("n_name").alias("attribute"))
    own = region.unionByName(nation)
    up = graph.closure(is_a(spark, sf_dir))
    inherited = up.join(own.withColumnRenamed("concept_id", "ancestor"), "ancestor").select(F.col("child").alias("concept_id"), "attribute")
    return own.unionByName(inherited).distinct()


def property_chain_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplied_by o located_in: a part is located where a supplier of it is, and in what that is part of."""
    supplied = table(spark, sf_dir, "lineitem").select(_long("l_partkey", t.PART).alias("child"), _long("l_suppkey", t.SUPPLIER).alias("parent"))
    reached = graph.chain_closure(supplied, graph.closure(is_a(spark, sf_dir, customers=False)))
    return reached.filter(F.col("ancestor") < t.SUPPLIER).select(F.col("child").alias("part_id"), F.col("ancestor").alias("located_in"))


# -- groups -----------------------------------------------------------------------------------------------------------


def role_group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(_long("l_orderkey").alias("source_id"), F.col("l_linenumber").cast(long).alias("relationship_group"), _long("l_partkey").alias("d"))
    return rows.groupBy("source_id", "relationship_group").agg(F.array_join(F.transform(F.array_sort(F.collect_set("d")), lambda x: x.cast("string")), ",").alias("destinations"), F.count(F.lit(1)).alias("n"))


def role_group_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's groups are its pairs of supplier and line; line 1 is group 0."""
    rows = table(spark, sf_dir, "lineitem").select(
        _long("l_orderkey").alias("source_id"), _long("l_suppkey").alias("part"), F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_linenumber")).alias("relationship_group")
    ).distinct()
    kept = rows.withColumn("old_group", F.col("relationship_group").cast(long))
    return groups.merged_numbers(kept, ["source_id"], "part", "relationship_group").select("source_id", "part", "old_group", F.col("relationship_group").cast(long).alias("new_group"))


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (owner, row, grp, typeId, destinationId): an order's suppliers (odd lines) and their places (even lines)."""
    line = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    place = F.when(F.col("l_linenumber") % 2 == 1, _long("l_suppkey", t.SUPPLIER)).otherwise(_long("s_nationkey", t.NATION))
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        _long("l_orderkey", t.ORDER).alias("owner"), F.col("l_linenumber").cast(long).alias("grp"), (F.lit(1) + F.col("l_linenumber") % 2).cast(long).alias("typeId"), place.alias("destinationId")
    ).distinct()
    return rows.withColumn("row", F.col("destinationId") * 100 + F.col("grp") * 10 + F.col("typeId"))


def _closures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Type 2 is below type 1; destinations are below their nations and regions."""
    edges = is_a(spark, sf_dir, customers=False)
    nodes = edges.select(F.col("child").alias("n")).unionByName(edges.select(F.col("parent").alias("n"))).distinct()
    types = spark.createDataFrame([(1, 1), (2, 2), (2, 1)], "child long, ancestor long")
    return types, graph.reflexive(graph.closure(edges), nodes)


def fragment_subsumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attributes(spark, sf_dir)
    pairs = groups.stronger_pairs(rows, rows, ["owner"], *_closures(spark, sf_dir))
    return pairs.filter("row_l <> row_r").select("owner", "row_l", "row_r")


def concrete_subsumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders own their lines' quantities; a quantity counts as stronger if the text is equal and its type the same or below."""
    line, type_ = table(spark, sf_dir, "lineitem"), (F.lit(1) + F.col("l_linenumber") % 2).cast(long)
    rows = line.select(
        _long("l_orderkey", t.ORDER).alias("owner"), (F.col("l_partkey") * 100 + F.col("l_linenumber") * 10 + type_).cast(long).alias("row"), F.col("l_linenumber").cast(long).alias("grp"),
        type_.alias("typeId"), F.concat(F.lit("#"), F.col("l_quantity").cast(long)).alias("value"),
    ).distinct()
    types = spark.createDataFrame([(1, 1), (2, 2), (2, 1)], "child long, ancestor long")
    return groups.same_value_pairs(rows, rows, ["owner"], types).filter("row_l <> row_r").select("owner", "row_l", "row_r")


def _flag_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers' orders as groups of (returnflag, linestatus) pairs; and which group contains which."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber").distinct()
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _long("o_custkey", t.CUSTOMER).alias("owner"), _long("l_orderkey").alias("grp"), F.concat("l_returnflag", "l_linestatus").alias("item")
    ).distinct()
    return groups.item_sets(rows, ["owner"])


def group_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sets of a customer, each named by its first order, and which holds which; orders follow from membership."""
    sets, _ = _flag_sets(spark, sf_dir)
    return groups.set_containment(sets, ["owner"])


def group_antichain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a customer's orders with equal sets the first stays, unless another order's set holds its own."""
    sets, _ = _flag_sets(spark, sf_dir)
    sets = stored(sets, "sets")
    sizes = sets.select("owner", "grp", F.size("items").cast(long).alias("n"), F.col("grp").alias("ord"))
    return groups.antichain(sizes, groups.set_containment(sets, ["owner"]), ["owner"], "ord").select("owner", "grp", "n")


# -- changes ------------------------------------------------------------------------------------------------------------


def _published(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old and new relationships of orders: suppliers of lines that are not "R", and of lines that are not "A"."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(
        F.col("l_returnflag").alias("flag"), _long("l_orderkey").alias("source_id"), _long("l_suppkey").alias("destination_id"),
        (F.lit(1) + F.col("l_linenumber") % 3).cast(long).alias("typeId"), F.col("l_quantity").cast(long).alias("value"),
        F.when(F.col("l_returnflag") == "A", 0).otherwise(F.col("l_linenumber") % 2).cast(long).alias("grp"), F.col("l_linenumber").cast(long).alias("n"),
    )
    keys = ["source_id", "destination_id", "typeId", "value", "grp"]
    old = rows.filter("flag <> 'R'").groupBy(*keys, "n").agg(F.lit(1).alias("one"))
    old = old.select(*keys, "n", (F.col("source_id") * 10_000_000 + F.col("destination_id") * 1000 + F.col("n") * 100 + F.col("value")).alias("id"), F.col("n").alias("moduleId"))
    moved = rows.filter("flag = 'A' and n % 4 = 1").withColumn("grp", F.col("n") + 10)
    new = rows.filter("flag <> 'A'").select(*keys).unionByName(moved.select(*keys)).distinct()
    return old, new


def relationship_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _published(spark, sf_dir)
    return diff.compare(old, new, "source_id", ["typeId", "destination_id", "value"], "grp", IS_A)


def group_zero_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationship_diff(spark, sf_dir).filter("action = 'move'").select("id", "source_id", F.col("grp").alias("new_group"))


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.change_counts(relationship_diff(spark, sf_dir))


def retired_id_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders take the id of the customer's most recent filled order of the same priority."""
    orders = table(spark, sf_dir, "orders")
    key = ["o_custkey", "o_orderpriority"]
    added = orders.filter("o_orderstatus = 'O'").select("o_orderkey", *key)
    pool = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("effectiveTime"), *key)
    return diff.reuse_ids(added, pool, key).select("o_orderkey", "o_custkey", "reused_id")


def reconcile_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's first order before the date is published, the first since then is regenerated."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    first = lambda df: df.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("axiom"))
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    return diff.reconcile(first(orders.filter(F.col("o_orderdate") < cut)), first(orders.filter(F.col("o_orderdate") >= cut)), "o_custkey", "axiom")


def stated_retirement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N' and l_linestatus = 'O'")
    row = values.file_row([_long("l_orderkey", t.ORDER), F.lit(""), F.lit("0"), _long("l_suppkey"), _long("l_partkey", t.PART), F.col("l_linenumber"), F.lit(IS_A)])
    return line.select(_long("l_orderkey", t.ORDER).alias("source_id"), row.alias("row_text"))


def concept_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    subset = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").join(subset, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey", "left_semi").select("l_orderkey", "l_partkey", F.col("l_linenumber").cast(long).alias("l_linenumber"))


def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as concepts and lines as relationships, written as entries of one archive and read as a release."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    concept = values.file_row([_long("p_partkey", t.PART), F.lit(20200101), F.lit(1), F.lit(CORE_MODULE), F.when(F.col("p_size") >= 25, DEFINED).otherwise(PRIMITIVE)])
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    edge = values.file_row([
        number, F.lit(20200101), (F.col("l_linestatus") == "O").cast("int"), F.lit(CORE_MODULE), _long("l_orderkey", t.ORDER), _long("l_partkey", t.PART), F.col("l_linenumber"),
        _long("l_suppkey", t.SUPPLIER), F.lit(INFERRED), F.lit(EXISTENTIAL),
    ])
    of = lambda df, entry, row, key: df.select(F.lit(entry).alias("entry"), row.alias("line"), key.alias("key"))
    rows = of(part, "Terminology/sct2_Concept_Snapshot.txt", concept, F.col("p_partkey")).unionByName(of(line, "Terminology/sct2_Relationship_Snapshot.txt", edge, number))
    write_entries(rows, path := f"{fresh_path(spark, 'archive')}.zip", ["key", "line"])
    raw = read_raw(spark, [path])
    concepts = raw["concept"].select("id", "active", F.col("definitionStatusId").alias("other"), F.lit(0).cast(long).alias("grp"))
    return concepts.unionByName(raw["relationship"].select("id", "active", F.col("destinationId").alias("other"), F.col("relationshipGroup").cast(long).alias("grp")))


# -- axioms ------------------------------------------------------------------------------------------------------------


def _part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a root concept with a brand and a type in one role group, and a concrete size that is never grouped."""
    part = table(spark, sf_dir, "part")
    brand, kind = _long_code("p_brand", t.BRAND), _long_code("p_type", t.TYPE)
    me, none = _long("p_partkey", t.PART).alias("conceptId"), F.lit(None).cast("string")
    row = lambda grp, type_, dest, k=none, x=none: part.select(me, F.lit(grp).alias("grp"), F.lit(type_).cast(long).alias("typeId"), dest.cast(long).alias("destinationId"), k.alias("kind"), x.alias("text"))
    return (
        row(0, IS_A, F.lit(t.PART)).unionByName(row(1, 101, brand)).unionByName(row(1, 102, kind))
        .unionByName(row(0, 103, F.lit(None), F.lit("INTEGER"), F.col("p_size").cast("string")))
    )


def _long_code(name: str, base: int):
    """A number for a text: base plus 24 bits of its digest."""
    return (F.lit(base) + F.lit(1_000_000) + _digits(F.col(name), 6)).cast(long)


def _digits(c, n: int):
    return F.conv(F.substring(F.md5(c), 1, n), 16, 10).cast(long)


def class_axiom_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ungrouped = spark.createDataFrame([(103,)], "attributeId long")
    defined = table(spark, sf_dir, "part").filter("p_size >= 25").select(_long("p_partkey", t.PART).alias("conceptId"))
    made = axioms.class_axioms(axioms.class_expressions(_part_rows(spark, sf_dir), ungrouped), defined)
    return made.select(F.col("conceptId").alias("concept_id"), "axiom")


def axiom_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = class_axiom_text(spark, sf_dir).select("concept_id", F.explode(values.signature(F.col("axiom"))).alias("named_id"))
    return named


def axiom_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to rows and back to texts."""
    texts = class_axiom_text(spark, sf_dir).select(F.col("concept_id").cast("string").alias("axiom_id"), F.col("concept_id").alias("component"), "axiom")
    rows = stored(axioms.relationships(texts).filter("side = 'right' and error is null"), "axiom-rows")
    plain = rows.select(F.col("left_concept").alias("conceptId"), "grp", "typeId", "destinationId", "kind", "text")
    defined = rows.filter("not primitive").select(F.col("left_concept").alias("conceptId")).distinct()
    ungrouped = spark.createDataFrame([(103,)], "attributeId long")
    back = axioms.class_axioms(axioms.class_expressions(plain, ungrouped), defined)
    return back.select(F.col("conceptId").alias("concept_id"), "axiom")


def property_flags_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's kinds of event as axioms about one property: flags are or-ed, texts joined."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    text = F.when(F.col("event_type") == "click", F.concat(F.lit("TransitiveObjectProperty(:"), F.col("user_id"), F.lit(")"))).when(
        F.col("event_type") == "view", F.concat(F.lit("ReflexiveObjectProperty(:"), F.col("user_id"), F.lit(")"))
    ).otherwise(F.concat(F.lit("SubObjectPropertyOf(ObjectPropertyChain(:1 :2) :"), F.col("user_id"), F.lit(")")))
    marked = rows.withColumn("axiom", text)
    flags = marked.select("user_id", "axiom", *values.property_flags(F.col("axiom")))
    return flags.groupBy("user_id").agg(
        F.bool_or("transitive").alias("transitive"), F.bool_or("reflexive").alias("reflexive"), F.bool_or("chain").alias("chain"),
        F.array_join(F.array_sort(F.collect_set("axiom")), "\n").alias("axioms"),
    )


def description_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as terms, sources as refsets: a tag where exactly one source holds over 50 documents of the language."""
    docs = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    dialect = F.when(F.col("source") == "src0", "").otherwise(F.regexp_replace("source", "src", "x"))
    top = docs.withColumn("most", F.max("n").over(Window.partitionBy("lang")))
    marked = top.groupBy("lang").agg(F.sum((F.col("n") == F.col("most")).cast(long)).alias("preferred"), F.array_sort(F.collect_set(F.when(F.col("n") == F.col("most"), dialect))).alias("dialects"))
    return marked.select("lang", "preferred", values.language_tag(F.col("lang"), F.col("preferred"), F.col("dialects")).alias("tag"))


def acceptability_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels as a map, flattened in order of key."""
    labels = table(spark, sf_dir, "labels")
    pairs = labels.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("k"), F.col("quality").alias("v")), F.struct(F.lit("toxic").alias("k"), F.col("toxic").alias("v")))).alias("e")).filter("e.v = 1")
    maps = pairs.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_set("e"))).alias("m"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(maps, "doc_id")
    flat = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return docs.select("doc_id", "lang", flat.alias("acceptability"))


# -- classification -------------------------------------------------------------------------------------------------------


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, and the numbers of its brand, type and size; once, by all tasks, since each is a digest."""
    part = table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)
    return stored(part.select(_long("p_partkey", t.PART).alias("part"), _long_code("p_brand", t.BRAND).alias("b"), _long_code("p_type", t.TYPE).alias("y"), (F.lit(t.SIZE) + F.col("p_size")).cast(long).alias("s")), "coded")


def _wide(*c: str):
    """The number of a class of brand, of brand and type, or of all three."""
    return (F.lit(1 << 40) * len(c) + _digits(F.concat_ws("|", *[F.col(x).cast("string") for x in c]), 9)).cast(long)


def _definitions(part: DataFrame) -> DataFrame:
    """(concept, attribute): classes of brand, brand and type, and brand, type and size; and the parts."""
    out = []
    for cols in (("b",), ("b", "y"), ("b", "y", "s")):
        met = part.select(*cols).distinct()
        rows = met.select(_wide(*cols).alias("concept"), F.explode(F.array(*[F.col(c) for c in cols])).alias("attribute")).distinct()
        out.append(rows.withColumn("defined", F.lit(True)))
    parts = part.select(F.col("part").alias("concept"), F.explode(F.array("b", "y", "s")).alias("attribute")).withColumn("defined", F.lit(False))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(parts)


def _rules(definitions: DataFrame) -> DataFrame:
    """Normal form: a concept is below `some has attribute`; a defined one is also above their intersection."""
    some = -F.col("attribute")
    none, null = F.lit(None).cast(long), F.lit(None).cast("int")
    row = lambda df, rule, a, b, c=none, n=null: df.select(F.lit(rule).alias("rule"), a.alias("a"), b.alias("b"), c.alias("c"), n.alias("n"))
    size = definitions.filter("defined").groupBy("concept").agg(F.count(F.lit(1)).cast("int").alias("n"))
    defined = definitions.filter("defined").join(size, "concept")
    each = definitions.select("attribute").distinct()
    return (
        row(each, "exists", some, F.lit(1).cast(long), F.col("attribute"))
        .unionByName(row(definitions, "told", F.col("concept"), some))
        .unionByName(row(defined, "member", some, F.col("concept"), n=F.col("n")))
    )


def el_roles_and_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existentials, a role hierarchy, a chain and a reflexive role.

    Suppliers and customers are located (1) in a nation, customers by a role below that (2); nations are part (3) of a
    region; to be located in what is part of a place is to be located in that place; and every concept is located in
    itself.  For each place a class is defined by what is located there: its number is the place's and LOCAL.
    """
    edge = lambda table_, c, c0, p, p0, role: table(spark, sf_dir, table_).select(_long(c, c0).alias("c"), F.lit(role).cast(long).alias("role"), _long(p, p0).alias("place"))
    facts = edge("supplier", "s_suppkey", t.SUPPLIER, "s_nationkey", t.NATION, 1).unionByName(edge("customer", "c_custkey", t.CUSTOMER, "c_nationkey", t.NATION, 2)).unionByName(edge("nation", "n_nationkey", t.NATION, "n_regionkey", t.REGION, 3))
    places = table(spark, sf_dir, "nation").select(_long("n_nationkey", t.NATION).alias("place")).unionByName(table(spark, sf_dir, "region").select(_long("r_regionkey", t.REGION).alias("place")))
    some = lambda role: -(F.col("place") * 10 + role)
    none, null = F.lit(None).cast(long), F.lit(None).cast("int")
    row = lambda df, rule, a, b, c=none: df.select(F.lit(rule).alias("rule"), a.alias("a"), b.alias("b"), c.alias("c"), null.alias("n"))
    fixed = spark.createDataFrame([("role", 2, 1, None, None), ("chain", 1, 3, 1, None), ("reflexive", 1, None, None, None)], "rule string, a long, b long, c long, n int")
    local = F.col("place") + LOCAL
    rules = row(facts, "told", F.col("c"), some(F.col("role"))).unionByName(row(places, "told", local, some(F.lit(1)))).unionByName(row(places, "told", some(F.lit(1)), local))
    for role in (1, 2, 3):
        rules = rules.unionByName(row(places, "exists", some(F.lit(role)), F.lit(role).cast(long), F.col("place")))
    return classify.saturate(rules.unionByName(fixed))


def el_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.saturate(_rules(stored(_definitions(_coded(spark, sf_dir)), "definitions")))


def classification_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classify, reduce to direct parents, and compare with the published ones: each part's class of brand and type."""
    part = _coded(spark, sf_dir)
    old = part.select(
        F.col("part").alias("source_id"), F.lit(IS_A).cast(long).alias("typeId"), _wide("b", "y").alias("destination_id"),
        F.lit(0).alias("grp"), (F.col("part") - t.PART).alias("id"), F.lit(1).alias("moduleId"),
    )
    rules, leaves = classify.shared_leaves(stored(_rules(stored(_definitions(part), "definitions")), "rules"))
    subsumed, same = classify.saturated(rules)
    parents, _, _ = classify.taxonomy(subsumed, old, same, leaves)
    new = parents.filter(F.col("child").between(t.PART, t.PART + 9_999_999)).select(F.col("child").alias("source_id"), F.lit(IS_A).cast(long).alias("typeId"), F.col("parent").alias("destination_id"), F.lit(0).alias("grp"))
    return diff.compare(old, new, "source_id", ["typeId", "destination_id"], "grp", IS_A).select("action", "id", "source_id", "destination_id")


# -- normal form ----------------------------------------------------------------------------------------------------------


def normal_form_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of places, suppliers and customers, and what of their parents' attributes they don't imply.

    Each place has itself by role 1; suppliers their nation by role 2, which is below 1; customers with money a group of
    their nation by role 2 and a number, a weaker group with their region by role 1 if they are builders, and a group of
    their own kind with role 4.  The others inherit their nation's.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).filter("c_acctbal >= 0")
    nothing = F.lit(None)
    row = lambda df, c, grp, type_, dest=nothing, value=nothing: df.select(
        c.alias("conceptId"), F.lit(grp).cast("int").alias("grp"), F.lit(type_).cast(long).alias("typeId"), dest.cast(long).alias("destinationId"), value.cast("string").alias("value")
    )
    me, place, top = _long("c_custkey", t.CUSTOMER), _long("c_nationkey", t.NATION), _long("n_regionkey", t.REGION)
    builders = customer.filter("c_mktsegment = 'BUILDING'")
    segment = F.lit(t.BRAND) + F.length("c_mktsegment")
    region, supplier = table(spark, sf_dir, "region"), table(spark, sf_dir, "supplier")
    own = (
        row(region, _long("r_regionkey", t.REGION), 0, 1, _long("r_regionkey", t.REGION))
        .unionByName(row(nation, _long("n_nationkey", t.NATION), 0, 1, _long("n_nationkey", t.NATION)))
        .unionByName(row(supplier, _long("s_suppkey", t.SUPPLIER), 0, 2, _long("s_nationkey", t.NATION)))
        .unionByName(row(customer, me, 1, 2, place))
        .unionByName(row(customer, me, 1, 3, value=F.concat(F.lit("#"), F.col("c_nationkey"))))
        .unionByName(row(builders, me, 2, 1, top))
        .unionByName(row(builders, me, 3, 4, segment))
    )
    edges = is_a(spark, sf_dir)
    nodes = edges.select(F.col("child").alias("n")).unionByName(edges.select(F.col("parent").alias("n"))).distinct()
    types = spark.createDataFrame([(1, 1), (2, 2), (2, 1), (3, 3), (4, 4)], "child long, ancestor long")
    found = normal_form.inferred_attributes(own, edges, types, graph.reflexive(graph.closure(edges), nodes))
    return found.select("conceptId", F.col("grp").cast(long).alias("grp"), "typeId", "destinationId", "value")


def chain_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes with a chain and a transitive property, and universal rows beside existential ones.

    Nations are part (3) of their region.  Suppliers and customers are located (1) in their nation and in its region, which the chain
    "located in what is part of a place" implies; customers are part of both, which transitivity implies.  Builders are
    also located in their region universally, which no existential row implies.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    row = lambda df, c, grp, type_, dest, universal=False: df.select(
        c.alias("conceptId"), F.lit(grp).alias("grp"), F.lit(type_).cast(long).alias("typeId"), dest.alias("destinationId"), F.lit(None).cast("string").alias("value"), F.lit(universal).alias("universal")
    )
    near, far = _long("n_nationkey", t.NATION), _long("n_regionkey", t.REGION)
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    own = row(nation, near, 0, 3, far)
    for df, c in ((supplier, _long("s_suppkey", t.SUPPLIER)), (customer, _long("c_custkey", t.CUSTOMER))):
        own = own.unionByName(row(df, c, 1, 1, near)).unionByName(row(df, c, 2, 1, far))
    own = own.unionByName(row(customer, _long("c_custkey", t.CUSTOMER), 3, 3, near)).unionByName(row(customer, _long("c_custkey", t.CUSTOMER), 4, 3, far))
    own = own.unionByName(row(customer.filter("c_mktsegment = 'BUILDING'"), _long("c_custkey", t.CUSTOMER), 5, 1, far, True))
    chains = spark.createDataFrame([(1, 3, 1), (3, 3, 3)], "first long, second long, whole long")
    none, parents = spark.createDataFrame([], "child long, ancestor long"), spark.createDataFrame([], "child long, parent long")
    found = normal_form.inferred_attributes(own, parents, none, none, chains)
    return found.select("conceptId", F.col("grp").cast(long).alias("grp"), "typeId", "destinationId", "universal")


def stable_group_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as groups, published twice: by the core module from 50 down, by another from 8 down; the core's numbers stay."""
    line = table(spark, sf_dir, "lineitem").select(
        _long("l_orderkey", t.ORDER).alias("conceptId"), F.col("l_linenumber").alias("grp"), F.col("l_linenumber").cast(long).alias("typeId"),
        _long("l_partkey", t.PART).alias("destinationId"), F.lit(None).cast("string").alias("value"),
    ).distinct()
    line = stored(line, "lines")
    core = line.withColumns({"grp": F.lit(50) - F.col("grp"), "moduleId": F.lit(CORE_MODULE).cast(long)})
    other = line.withColumns({"grp": F.lit(8) - F.col("grp"), "moduleId": F.lit(1).cast(long)})
    found = normal_form.stable_numbers(line, core.unionByName(other))
    return found.select("conceptId", F.col("grp").cast(long).alias("grp"), "typeId", "destinationId")


def _release(spark: SparkSession, sf_dir: str) -> Release:
    """Places, suppliers and customers as a release: stated is-a and the nation's market, which is an attribute below the roots."""
    edges = is_a(spark, sf_dir)
    root = edges.select(F.lit(t.REGION - 1).cast(long).alias("child")).limit(1)
    tops = table(spark, sf_dir, "region").select(_long("r_regionkey", t.REGION).alias("child"), F.lit(t.REGION - 1).cast(long).alias("parent"))
    model = spark.createDataFrame([(OBJECT_ATTRIBUTE, MODEL_ATTRIBUTE), (MARKET, OBJECT_ATTRIBUTE), (MODEL_ATTRIBUTE, t.REGION - 1)], "child long, parent long")
    every = edges.unionByName(tops).unionByName(model)
    ids = every.select(F.col("child").alias("id")).unionByName(root.select(F.col("child").alias("id")))
    wide = lambda df, type_, grp: df.select(
        F.col("child").alias("id"), F.lit(20200101).alias("effectiveTime"), F.lit(True).alias("active"), F.lit(CORE_MODULE).cast(long).alias("moduleId"), F.col("child").alias("sourceId"),
        F.col("parent").alias("destinationId"), F.lit(grp).alias("relationshipGroup"), F.lit(type_).cast(long).alias("typeId"), F.lit(STATED).cast(long).alias("characteristicTypeId"), F.lit(EXISTENTIAL).cast(long).alias("modifierId"),
    )
    markets = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(_long("c_custkey", t.CUSTOMER).alias("child"), _long("c_nationkey", t.NATION).alias("parent"))
    none = lambda schema: spark.createDataFrame([], schema)
    stated = wide(every, IS_A, 0).unionByName(wide(markets, MARKET, 1))
    # published: what is stated, but customers without money still have a market, in group 0
    poor = table(spark, sf_dir, "customer").select(_long("c_custkey", t.CUSTOMER).alias("child"), _long("c_nationkey", t.NATION).alias("parent"))
    inferred = wide(every, IS_A, 0).unionByName(wide(poor, MARKET, 0)).withColumn("value", F.lit(None).cast("string"))
    concepts = ids.distinct().select("id", F.lit(CORE_MODULE).cast(long).alias("moduleId"), F.lit(False).alias("defined"))
    return Release(
        concepts=concepts, inactive=none("id long"), modules=concepts.select("id", "moduleId"), stated=stated, inferred=inferred,
        pool=stated.limit(0), axioms=none("axiom_id string, component long, moduleId long, axiom string"), ontology=none("id string, row long, text string"), ungrouped=none("contentTypeId long, attributeId long"),
    )


def generated_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.generated_axioms(spark, _release(spark, sf_dir))


def release_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole classification: axioms from stated rows, subsumption, normal form, stable numbers, delta."""
    return services.classify_release(spark, _release(spark, sf_dir)).delta.select(
        "action", F.col("sourceId").alias("source_id"), "typeId", F.col("destinationId").alias("destination_id"), F.col("grp").cast(long).alias("grp")
    )


QUERIES = {f.__name__: f for f in (
    latest_state_merge, snapshot_delta_overlay, definition_status_split, orphan_sources, relationship_projection, concrete_value_parse,
    stated_isa_closure, descendants_of, direct_parents_reduction, hierarchy_levels, equivalent_sets, ungrouped_roles_default, role_group_rows,
    role_group_numbering, fragment_subsumption, concrete_subsumption, property_chain_closure, group_containment, group_antichain,
    inherited_attributes, relationship_diff, group_zero_move, retired_id_reuse, inactivation_retirement, change_counts, class_axiom_text,
    axiom_signature, axiom_round_trip, property_flags_merge, description_annotations, acceptability_map, el_classification,
    stated_retirement_rows, reconcile_axioms, concept_extract, classification_delta, el_roles_and_chains, normal_form_attributes,
    stable_group_numbers, generated_axioms, release_delta, streamed_states, archive_round_trip, chain_normal_form, cycle_members, numbered_orders,
)}
