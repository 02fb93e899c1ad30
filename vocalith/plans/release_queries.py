"""Queries that write the driver's tables as files of a release, and run the services on these files; and their SQL.

International release: a top concept, regions, nations and customers below each other by stated is-a rows, and a role MARKET of
customers with money to their nation; of these the ones of the segment MACHINERY are defined.  Suppliers with money have concepts of their
own in an extension's module; those without are named by relationships alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith import schema
from vocalith.functions.values import file_row
from vocalith.plans import ontology, services
from vocalith.plans import tables as t
from vocalith.plans.tables import is_a, table
from vocalith.schema import CORE_MODULE, DEFINED, EXISTENTIAL, FILES, INFERRED, IS_A, MODEL_ATTRIBUTE, OBJECT_ATTRIBUTE, PRIMITIVE, ROLE_GROUP, STATED
from vocalith.sources import releases
from vocalith.sources.archives import write_entries
from vocalith.sources.shared import fresh_path

TOP, MARKET, EXTENSION = t.REGION - 1, 900, 777
DAY = 20200101
CORE, ADDRESS = "http://example.org/id/", "http://example.org/ontology"
FIRST_DIALECT, SECOND_DIALECT = ontology.DIALECTS
Kinds = dict[str, DataFrame]


def _long(c: str, plus: int = 0) -> Column:
    return (F.col(c) + F.lit(plus)).cast("long")


def _row(df: DataFrame, *cells) -> DataFrame:
    return df.select(file_row([c if isinstance(c, Column) else F.lit(c) for c in cells]).alias("line"))


def archive(spark: SparkSession, kinds: Kinds) -> str:
    """The path of an archive with a file of each kind (rows of `line`)."""
    made = None
    for kind, rows in kinds.items():
        name = FILES[kind][0].replace("(Description|TextDefinition)", "Description").rstrip("_")
        one = rows.select(F.lit(f"Snapshot/{name}_Snapshot.txt").alias("entry"), "line")
        made = one if made is None else made.unionByName(one)
    path = f"{fresh_path(spark, 'release')}.zip"
    write_entries(made, path, ["line"])
    return path


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, status, segment (of customers)."""
    defined = (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") >= 0)
    customer = table(spark, sf_dir, "customer").select(_long("c_custkey", t.CUSTOMER).alias("id"), F.col("c_mktsegment").alias("segment"), F.when(defined, DEFINED).otherwise(PRIMITIVE).alias("status"))
    rest = is_a(spark, sf_dir).filter(F.col("child") < t.SUPPLIER).select(F.explode(F.array("child", "parent")).alias("id")).distinct()
    model = spark.createDataFrame([(TOP,), (MODEL_ATTRIBUTE,), (OBJECT_ATTRIBUTE,), (MARKET,)], "id long")
    return customer.unionByName(rest.unionByName(model).withColumns({"segment": F.lit(None).cast("string"), "status": F.lit(PRIMITIVE)}))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, type, parent, grp: what is stated in the international release."""
    tree = is_a(spark, sf_dir).filter(~F.col("child").between(t.SUPPLIER, t.CUSTOMER - 1))
    tops = table(spark, sf_dir, "region").select(_long("r_regionkey", t.REGION).alias("child"), F.lit(TOP).cast("long").alias("parent"))
    model = spark.createDataFrame([(OBJECT_ATTRIBUTE, MODEL_ATTRIBUTE), (MARKET, OBJECT_ATTRIBUTE), (MODEL_ATTRIBUTE, TOP)], "child long, parent long")
    up = tree.unionByName(tops).unionByName(model).select("child", F.lit(IS_A).cast("long").alias("type"), "parent", F.lit(0).alias("grp"))
    rich = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    return up.unionByName(rich.select(_long("c_custkey", t.CUSTOMER).alias("child"), F.lit(MARKET).cast("long").alias("type"), _long("c_nationkey", t.NATION).alias("parent"), F.lit(1).alias("grp")))


def _edge_rows(edges: DataFrame, kind: int, active="1", module: int = CORE_MODULE, time=DAY) -> DataFrame:
    """The id is the child's, with the group as a last digit."""
    return _row(edges, F.col("child") * 10 + F.col("grp"), time, active, module, F.col("child"), F.col("parent"), F.col("grp"), F.col("type"), kind, EXISTENTIAL)


def base(spark: SparkSession, sf_dir: str) -> Kinds:
    edges = _edges(spark, sf_dir)
    poor = is_a(spark, sf_dir, customers=False).filter(F.col("child") >= t.SUPPLIER).select("child", F.lit(IS_A).cast("long").alias("type"), "parent", F.lit(0).alias("grp"))
    lost = poor.join(table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(_long("s_suppkey", t.SUPPLIER).alias("child")), "child", "left_semi")
    head = spark.createDataFrame([("p", schema.NAMESPACE_ROW, f"Prefix(:=<{CORE}>)"), ("h", schema.HEADER_ROW, f"Ontology(<{ADDRESS}>)")], "id string, row long, text string")
    return {
        "concept": _row(_concepts(spark, sf_dir), F.col("id"), DAY, "1", CORE_MODULE, F.col("status")),
        "stated": _edge_rows(edges, STATED),
        "relationship": _edge_rows(edges.select("child", "type", "parent", "grp").unionByName(lost.select("child", "type", "parent", "grp")), INFERRED),
        "ontology": _row(head, F.col("id"), DAY, "1", CORE_MODULE, schema.ONTOLOGY_REFSET, F.col("row"), F.col("text")),
    }


def delta(spark: SparkSession, sf_dir: str) -> Kinds:
    """Builders' concepts are inactivated and the inferred roles of furniture customers are, without a time; others come as they were, but earlier."""
    concepts = _concepts(spark, sf_dir)
    gone = concepts.filter("segment = 'BUILDING'")
    roles = _edges(spark, sf_dir).filter("grp = 1").join(concepts.filter("segment = 'FURNITURE'").select(F.col("id").alias("child")), "child", "left_semi")
    return {"concept": _row(gone, F.col("id"), "", "0", CORE_MODULE, F.col("status")), "relationship": _edge_rows(roles, INFERRED, "0", time="")}


def release_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is active, inactive (orphans too), stated, inferred and free for reuse after a delta, from two archives."""
    r = releases.load(spark, [archive(spark, base(spark, sf_dir))], archive(spark, delta(spark, sf_dir)), today=20200202)
    of = lambda df, what, other: df.select(F.lit(what).alias("what"), F.col("id").cast("long").alias("id"), other.cast("long").alias("other"))
    return (
        of(r.concepts, "concept", F.col("defined").cast("int"))
        .unionByName(of(r.inactive, "inactive", F.lit(None)))
        .unionByName(of(r.stated, "stated", F.col("destinationId")))
        .unionByName(of(r.inferred, "inferred", F.col("destinationId")))
        .unionByName(of(r.pool, "pool", F.col("effectiveTime")))
    )


def _descriptions(spark: SparkSession, sf_dir: str) -> Kinds:
    """Nations' names are full names, their comments synonyms that the first dialect prefers, or both dialects for odd keys, or none of the last ten."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", _long("n_nationkey", t.NATION).alias("id"), F.concat(F.col("n_name"), F.lit(' "')).alias("name"), F.concat(F.lit("in "), F.col("n_name")).alias("other"))
    tail = (CORE_MODULE,)
    fsn = _row(nation, F.col("id") * 10, DAY, "1", *tail, F.col("id"), "en", schema.FSN, F.col("name"), 0)
    synonym = _row(nation, F.col("id") * 10 + 1, DAY, "1", *tail, F.col("id"), "en", schema.SYNONYM, F.col("other"), 0)
    accept = lambda df, refset, a: _row(df, F.concat(F.lit(f"{refset}-"), F.col("id")), DAY, "1", *tail, refset, F.col("id") * 10 + 1, a)
    language = accept(nation.filter("n_nationkey < 15"), FIRST_DIALECT, schema.PREFERRED).unionByName(accept(nation.filter("n_nationkey < 15 and n_nationkey % 2 = 1"), SECOND_DIALECT, schema.PREFERRED))
    return {"description": fsn.unionByName(synonym), "language": language.unionByName(accept(nation.filter("n_nationkey >= 15"), SECOND_DIALECT, schema.ACCEPTABLE))}


def owl_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the release's document with labels, but for empty ones."""
    path = archive(spark, base(spark, sf_dir) | _descriptions(spark, sf_dir))
    return services.to_owl(spark, [path], version="1").filter("line <> ''").select("line")


def stated_to_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated rows to retire, and rows of generated axioms."""
    retired, made = services.stated_to_owl(spark, archive(spark, base(spark, sf_dir)))
    return retired.select(F.lit("stated").alias("file"), "row").unionByName(made.select(F.lit("axiom").alias("file"), "row"))


def extension_to_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension's suppliers: axiom rows, stated rows to retire, and stated rows about international concepts, which stay."""
    supplier = table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(_long("s_suppkey", t.SUPPLIER).alias("child"), F.lit(IS_A).cast("long").alias("type"), _long("s_nationkey", t.NATION).alias("parent"), F.lit(0).alias("grp"))
    extra = table(spark, sf_dir, "nation").select(_long("n_nationkey", t.NATION).alias("child"), F.lit(IS_A).cast("long").alias("type"), F.lit(TOP).cast("long").alias("parent"), F.lit(5).alias("grp"))
    own = {
        "concept": _row(supplier, F.col("child"), DAY, "1", EXTENSION, PRIMITIVE),
        "stated": _edge_rows(supplier, STATED, module=EXTENSION).unionByName(_edge_rows(extra, STATED, module=EXTENSION)),
    }
    made, retired, left = services.stated_to_owl_extension(spark, archive(spark, base(spark, sf_dir)), archive(spark, own))
    of = lambda df, name: df.select(F.lit(name).alias("file"), "row")
    return of(made, "axiom").unionByName(of(retired, "stated")).unionByName(of(left, "not converted"))


def extension_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta and equivalence sets of two archives and a delta.

    Defined customers of a nation are one class, and all others with money are below it; builders are inactivated with all their rows;
    roles of furniture customers are active again under their ids; the extension's suppliers are new, and its copies of
    rows that the core module has go; rows of suppliers without concepts go.
    """
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal >= 0")
    supplier = rich.select(_long("s_suppkey", t.SUPPLIER).alias("child"), F.lit(IS_A).cast("long").alias("type"), _long("s_nationkey", t.NATION).alias("parent"), F.lit(0).alias("grp"))
    copies = table(spark, sf_dir, "nation").select((_long("n_nationkey", t.NATION) * 10 + 7).alias("id"), _long("n_nationkey", t.NATION).alias("child"), _long("n_regionkey", t.REGION).alias("parent"))
    own = {
        "concept": _row(supplier, F.col("child"), DAY, "1", EXTENSION, PRIMITIVE),
        "stated": _edge_rows(supplier, STATED, module=EXTENSION),
        "relationship": _row(copies, F.col("id"), DAY, "1", EXTENSION, F.col("child"), F.col("parent"), 0, IS_A, INFERRED, EXISTENTIAL),
    }
    found = services.classify(spark, [archive(spark, base(spark, sf_dir)), archive(spark, own)], archive(spark, delta(spark, sf_dir)))
    columns = ["id", F.col("sourceId").alias("source_id"), F.col("typeId").alias("type_id"), F.col("destinationId").alias("destination_id"), F.col("grp").cast("long").alias("grp")]
    none = F.lit(None).cast("long")
    sets = found.equivalents.select(F.lit("equivalent").alias("action"), none.alias("id"), F.col("member").alias("source_id"), none.alias("type_id"), F.col("set_id").alias("destination_id"), none.alias("grp"))
    return found.delta.select("action", *columns).unionByName(sets)


def _published(spark: SparkSession, sf_dir: str) -> Kinds:
    """Axioms as they were published: none of regions, other ones of nations; builders were inactive then and households active now weren't known."""
    kinds = base(spark, sf_dir)
    concepts = _concepts(spark, sf_dir)
    made = ontology.generated_axioms(spark, releases.load(spark, [archive(spark, kinds)]))
    old = made.filter(~F.col("component").between(t.REGION, t.NATION - 1))
    text = F.when(F.col("component").between(t.NATION, t.NATION + 999), F.concat(F.lit("SubClassOf(:"), F.col("component"), F.lit(f" :{TOP})"))).otherwise(F.col("axiom"))
    axiom = _row(old.withColumn("text", text), F.concat(F.lit("p"), F.col("component")), DAY, "1", CORE_MODULE, schema.AXIOM_REFSET, F.col("component"), F.col("text"))
    state = F.when(F.col("segment") == "BUILDING", "0").otherwise("1")
    return kinds | {"axiom": axiom, "concept": _row(concepts, F.col("id"), DAY, state, CORE_MODULE, F.col("status"))}


def reconciled_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of new, modified, retired and reactivated axioms: households are inactivated in the authoring cycle, builders are active again."""
    gone = _concepts(spark, sf_dir).filter("segment = 'HOUSEHOLD'")
    cycle = archive(spark, {"concept": _row(gone, F.col("id"), "", "0", CORE_MODULE, F.col("status"))})
    return services.reconcile(spark, archive(spark, base(spark, sf_dir)), cycle, archive(spark, _published(spark, sf_dir))).select("component", "row")


def axioms_to_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated rows of published axioms, from a release of axioms alone."""
    kinds = _published(spark, sf_dir)
    path = archive(spark, {k: kinds[k] for k in ("concept", "axiom", "ontology")})
    return services.axioms_to_stated(spark, [path]).select("row")


def extracted_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of some concepts: the nations with an even key."""
    path = archive(spark, base(spark, sf_dir) | _descriptions(spark, sf_dir))
    ids = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(_long("n_nationkey", t.NATION).alias("id"))
    out = None
    for kind, rows in services.extract(spark, [path], ids).items():
        one = rows.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (extension_classification, release_states, owl_document, stated_to_axioms, extension_to_axioms, reconciled_release, axioms_to_stated, extracted_release)}

_E = f"""c AS (SELECT c_custkey + {t.CUSTOMER} AS id, c_nationkey + {t.NATION} AS nation, c_mktsegment AS segment, c_acctbal >= 0 AS rich FROM customer),
n AS (SELECT n_nationkey + {t.NATION} AS id, n_nationkey AS k, n_name AS name, n_regionkey + {t.REGION} AS region FROM nation),
up(child, parent) AS (SELECT id, nation FROM c UNION ALL SELECT id, region FROM n UNION ALL SELECT r_regionkey + {t.REGION}, {TOP} FROM region
  UNION ALL VALUES ({OBJECT_ATTRIBUTE}, {MODEL_ATTRIBUTE}), ({MARKET}, {OBJECT_ATTRIBUTE}), ({MODEL_ATTRIBUTE}, {TOP})),
ids(id) AS (SELECT child FROM up UNION ALL SELECT {TOP}),
edges(child, type, parent, grp) AS (SELECT child, {IS_A}, parent, 0 FROM up UNION ALL SELECT id, {MARKET}, nation, 1 FROM c WHERE rich),
ax(component, axiom) AS (
  SELECT id, CASE WHEN segment = 'MACHINERY' AND rich THEN 'EquivalentClasses(:' ELSE 'SubClassOf(:' END || id || CASE WHEN rich
    THEN ' ObjectIntersectionOf(:' || nation || ' ObjectSomeValuesFrom(:{ROLE_GROUP} ObjectSomeValuesFrom(:{MARKET} :' || nation || '))))' ELSE ' :' || nation || ')' END FROM c
  UNION ALL SELECT child, CASE WHEN child = {MARKET} THEN 'SubObjectPropertyOf(:' ELSE 'SubClassOf(:' END || child || ' :' || parent || ')' FROM up WHERE child NOT IN (SELECT id FROM c))"""
_UUID = lambda x: f"substr(md5({x}), 1, 8) || '-' || substr(md5({x}), 9, 4) || '-3' || substr(md5({x}), 14, 3) || '-8' || substr(md5({x}), 18, 3) || '-' || substr(md5({x}), 21, 12)"
_NEW = _UUID("component || '/' || axiom")
_TAB = lambda *c: f"concat_ws(chr(9), {', '.join(c)})"
_STATED = lambda module, active, a="edges": _TAB(f"{a}.child * 10 + {a}.grp", "''", f"'{active}'", str(module), f"{a}.child", f"{a}.parent", f"{a}.grp", f"{a}.type", str(STATED), str(EXISTENTIAL))
_PUBLISHED = f"""old(component, axiom) AS (SELECT component, CASE WHEN component BETWEEN {t.NATION} AND {t.NATION + 999} THEN 'SubClassOf(:' || component || ' :{TOP})' ELSE axiom END
  FROM ax WHERE component NOT BETWEEN {t.REGION} AND {t.NATION - 1})"""
_AXIOM_ROW = lambda id_, active, text, module=CORE_MODULE: _TAB(id_, "''", active, str(module), str(schema.AXIOM_REFSET), "component", text)

SQL = {
    "release_states": f"""
WITH {_E} SELECT 'concept' AS what, ids.id::BIGINT AS id, coalesce(segment = 'MACHINERY' AND rich, false)::BIGINT AS other FROM ids LEFT JOIN c USING (id) WHERE segment IS DISTINCT FROM 'BUILDING'
UNION ALL SELECT 'inactive', id, NULL FROM c WHERE segment = 'BUILDING' UNION ALL SELECT 'inactive', s_suppkey + {t.SUPPLIER}, NULL FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'stated', child * 10 + grp, parent FROM edges
UNION ALL SELECT 'inferred', child * 10 + grp, parent FROM edges LEFT JOIN c ON child = id WHERE grp = 0 OR segment <> 'FURNITURE'
UNION ALL SELECT 'inferred', (s_suppkey + {t.SUPPLIER}) * 10, s_nationkey + {t.NATION} FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'pool', id * 10 + 1, 20200202 FROM c WHERE rich AND segment = 'FURNITURE'""",
    "owl_document": f"""
WITH {_E},
role(id) AS (SELECT {MARKET} UNION ALL SELECT {ROLE_GROUP} UNION ALL SELECT {OBJECT_ATTRIBUTE}),
cls(id) AS (SELECT id FROM ids WHERE id <> {MARKET}),
tag AS (SELECT id, k, name, CASE WHEN k >= 15 THEN 'en-gb' WHEN k % 2 = 1 THEN 'en' ELSE 'en-us' END AS lang FROM n)
SELECT unnest(['Prefix(:=<{CORE}>)', {', '.join(f"'Prefix({p}:=<{i}>)'" for p, i in ontology.PREFIXES.items())}, 'Ontology(<{ADDRESS}>', '<{ADDRESS}/version/1>', ')',
  'Declaration(AnnotationProperty(skos:prefLabel))', 'Declaration(AnnotationProperty(skos:altLabel))']) AS line
UNION ALL SELECT unnest(['{"#" * 28}', '#   Object Properties', '{"#" * 28}', '{"#" * 28}', '#   Classes', '{"#" * 28}'])
UNION ALL SELECT 'Declaration(ObjectProperty(:' || id || '))' FROM role UNION ALL SELECT 'Declaration(Class(:' || id || '))' FROM cls
UNION ALL SELECT '# Object Property: <{CORE}{MARKET}> (<{CORE}{MARKET}>)'
UNION ALL SELECT '# Class: <{CORE}' || cls.id || '> (' || coalesce(name || ' "', '<{CORE}' || cls.id || '>') || ')' FROM cls LEFT JOIN n USING (id) WHERE cls.id <> {TOP}
UNION ALL SELECT axiom FROM ax
UNION ALL SELECT 'AnnotationAssertion(rdfs:label :' || id || ' "' || name || ' \\""@en)' FROM tag
UNION ALL SELECT 'AnnotationAssertion(skos:' || CASE WHEN k < 15 THEN 'pref' ELSE 'alt' END || 'Label :' || id || ' "in ' || name || '"@' || lang || ')' FROM tag""",
    "stated_to_axioms": f"""
WITH {_E} SELECT 'stated' AS file, {_STATED(CORE_MODULE, 0)} AS row FROM edges
UNION ALL SELECT 'axiom', {_AXIOM_ROW(_NEW, "'1'", "axiom")} FROM ax""",
    "extension_to_axioms": f"""
WITH s AS (SELECT s_suppkey + {t.SUPPLIER} AS component, 'SubClassOf(:' || (s_suppkey + {t.SUPPLIER}) || ' :' || (s_nationkey + {t.NATION}) || ')' AS axiom, s_nationkey + {t.NATION} AS parent FROM supplier WHERE s_acctbal >= 0),
e(child, type, parent, grp, file, active) AS (SELECT component, {IS_A}, parent, 0, 'stated', '0' FROM s UNION ALL SELECT n_nationkey + {t.NATION}, {IS_A}, {TOP}, 5, 'not converted', '1' FROM nation)
SELECT 'axiom' AS file, {_AXIOM_ROW(_NEW, "'1'", "axiom", EXTENSION)} AS row FROM s
UNION ALL SELECT file, {_TAB("e.child * 10 + e.grp", "''", "active", str(EXTENSION), "e.child", "e.parent", "e.grp", "e.type", str(STATED), str(EXISTENTIAL))} FROM e""",
    "extension_classification": f"""
WITH {_E}, top AS (SELECT nation, min(id) AS first FROM c WHERE rich AND segment = 'MACHINERY' GROUP BY nation),
s AS (SELECT s_suppkey + {t.SUPPLIER} AS id, s_nationkey + {t.NATION} AS nation, s_acctbal >= 0 AS rich FROM supplier),
moved AS (SELECT c.* , first FROM c JOIN top USING (nation) WHERE rich AND id <> first AND segment <> 'BUILDING')
SELECT 'remove' AS action, id * 10 AS id, id AS source_id, {IS_A}::BIGINT AS type_id, nation::BIGINT AS destination_id, 0::BIGINT AS grp FROM c WHERE segment = 'BUILDING'
UNION ALL SELECT 'remove', id * 10 + 1, id, {MARKET}, nation, 1 FROM c WHERE segment = 'BUILDING' AND rich
UNION ALL SELECT 'remove', id * 10, id, {IS_A}, nation, 0 FROM s WHERE NOT rich
UNION ALL SELECT 'add', NULL, id, {IS_A}, nation, 0 FROM s WHERE rich
UNION ALL SELECT 'remove', id * 10 + 7, id, {IS_A}, region, 0 FROM n
UNION ALL SELECT 'add', id * 10 + 1, id, {MARKET}, nation, 1 FROM c WHERE segment = 'FURNITURE' AND rich
UNION ALL SELECT 'remove', id * 10, id, {IS_A}, nation, 0 FROM moved UNION ALL SELECT 'add', NULL, id, {IS_A}, first, 0 FROM moved
UNION ALL SELECT 'equivalent', NULL, id, NULL, first, NULL FROM c JOIN top USING (nation) WHERE rich AND segment = 'MACHINERY'
  AND nation IN (SELECT nation FROM c WHERE rich AND segment = 'MACHINERY' GROUP BY nation HAVING count(*) > 1)""",
    "reconciled_release": f"""
WITH {_E}, {_PUBLISHED}
SELECT component::BIGINT AS component, {_AXIOM_ROW("'p' || component", "'1'", "axiom")} AS row FROM ax WHERE component BETWEEN {t.NATION} AND {t.NATION + 999}
UNION ALL SELECT component, {_AXIOM_ROW(_NEW, "'1'", "axiom")} FROM ax WHERE component BETWEEN {t.REGION} AND {t.NATION - 1}
UNION ALL SELECT component, {_AXIOM_ROW("'p' || component", "CASE WHEN segment = 'HOUSEHOLD' THEN '0' ELSE '1' END", "axiom")} FROM old JOIN c ON component = id WHERE segment IN ('HOUSEHOLD', 'BUILDING')""",
    "axioms_to_stated": f"""
WITH {_E}, {_PUBLISHED},
r AS (SELECT component, {IS_A} AS type, split_part(trim(split_part(axiom, ':', 3)), ')', 1) AS dest, 0 AS grp FROM old
  UNION ALL SELECT component, {MARKET}, nation::VARCHAR, 1 FROM old JOIN c ON component = id WHERE rich)
SELECT {_TAB(str(services.STATED_ID), "''", "'1'", str(CORE_MODULE), "component", "split_part(dest, ' ', 1)", "grp", "type", str(STATED), str(EXISTENTIAL), "''")} AS row FROM r""",
    "extracted_release": f"""
WITH n AS (SELECT n_nationkey AS k, n_nationkey + {t.NATION} AS id FROM nation WHERE n_nationkey % 2 = 0)
SELECT 'concept' AS kind, id::VARCHAR AS id FROM n UNION ALL SELECT 'description', (id * 10 + unnest([0, 1]))::VARCHAR FROM n
UNION ALL SELECT 'language', CASE WHEN k < 15 THEN '{FIRST_DIALECT}-' ELSE '{SECOND_DIALECT}-' END || id FROM n""",
}
