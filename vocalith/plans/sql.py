"""The queries of plans/queries.py in SQL."""

from __future__ import annotations

from vocalith.plans import tables as t
from vocalith.plans.queries import CUTOFF, LOCAL, MARKET
from vocalith.schema import DEFAULT_UNGROUPED, DEFINED, IS_A, MODEL_ATTRIBUTE, OBJECT_ATTRIBUTE, PRIMITIVE, ROLE_GROUP

_EDGES = f"""e(child, parent) AS (
  SELECT n_nationkey + {t.NATION}, n_regionkey + {t.REGION} FROM nation
  UNION ALL SELECT s_suppkey + {t.SUPPLIER}, s_nationkey + {t.NATION} FROM supplier
  UNION ALL SELECT c_custkey + {t.CUSTOMER}, c_nationkey + {t.NATION} FROM customer)"""
_SHORT = f"""{_EDGES}, s(child, parent) AS (SELECT child, parent FROM e
  UNION ALL SELECT c_custkey + {t.CUSTOMER}, n_regionkey + {t.REGION} FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_CLOSED = """x(child, ancestor) AS (SELECT child, parent FROM {e} UNION SELECT x.child, {e}.parent FROM x JOIN {e} ON x.ancestor = {e}.child)"""
_code = lambda c, base: f"({base} + 1000000 + ('0x' || substr(md5({c}), 1, 6))::BIGINT)"
_B, _Y, _S = _code("p_brand", t.BRAND), _code("p_type", t.TYPE), f"({t.SIZE} + p_size)::BIGINT"
_digits = lambda c: f"('0x' || substr(md5({c}), 1, 9))::BIGINT"

_ATTRIBUTES = f"""a AS (SELECT DISTINCT l_orderkey + {t.ORDER} AS owner, l_linenumber AS grp, 1 + l_linenumber % 2 AS typ,
    CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey + {t.SUPPLIER} ELSE s_nationkey + {t.NATION} END AS dest
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
r AS (SELECT *, dest * 100 + grp * 10 + typ AS id FROM a)"""
_FLAGS = f"""f AS (SELECT DISTINCT o_custkey + {t.CUSTOMER} AS owner, l_orderkey AS grp, l_returnflag || l_linestatus AS item
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT owner, min(grp) AS grp, items FROM (SELECT owner, grp, list_sort(list(item)) AS items FROM f GROUP BY ALL) GROUP BY owner, items),
z AS (SELECT owner, grp, len(items) AS n FROM s),
i AS (SELECT owner, grp, unnest(items) AS item FROM s),
p AS (SELECT a.owner, a.grp AS strong, b.grp AS weak, count(*) AS met FROM i a JOIN i b ON a.owner = b.owner AND a.item = b.item GROUP BY ALL),
c AS (SELECT p.owner, strong, weak FROM p JOIN z ON p.owner = z.owner AND weak = grp AND met = n WHERE strong <> weak)"""
_DIFF = f"""l AS (SELECT l_returnflag AS flag, l_orderkey AS s, l_suppkey AS d, (1 + l_linenumber % 3)::BIGINT AS typ, l_quantity::BIGINT AS v,
    (CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_linenumber % 2 END)::BIGINT AS g, l_linenumber::BIGINT AS n FROM lineitem),
o AS (SELECT DISTINCT s, d, typ, v, g, n, s * 10000000 + d * 1000 + n * 100 + v AS id FROM l WHERE flag <> 'R'),
w AS (SELECT s, d, typ, v, g FROM l WHERE flag <> 'A' UNION SELECT s, d, typ, v, n + 10 FROM l WHERE flag = 'A' AND n % 4 = 1),
k AS (SELECT o.*, row_number() OVER (PARTITION BY s, d, typ, v, g ORDER BY n DESC, id) AS nth, EXISTS (SELECT 1 FROM w WHERE (w.s, w.d, w.typ, w.v, w.g) = (o.s, o.d, o.typ, o.v, o.g)) AS hit FROM o),
fresh AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE (w.s, w.d, w.typ, w.v, w.g) = (o.s, o.d, o.typ, o.v, o.g))),
alone AS (SELECT s, g FROM w GROUP BY s, g HAVING count(*) = 1),
met AS (SELECT k.id, k.s, k.d, k.typ, k.v, fresh.g AS g, row_number() OVER (PARTITION BY k.id ORDER BY fresh.g) AS r FROM k
  JOIN fresh ON (k.s, k.d, k.typ, k.v) = (fresh.s, fresh.d, fresh.typ, fresh.v) JOIN alone ON alone.s = fresh.s AND alone.g = fresh.g
  WHERE NOT k.hit AND k.g = 0 AND k.typ <> {IS_A}),
mv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, d, typ, v, g ORDER BY id) AS t FROM met WHERE r = 1) WHERE t = 1),
delta AS (
  SELECT 'add' AS action, NULL::BIGINT AS id, s, typ, d, v, g FROM fresh WHERE NOT EXISTS (SELECT 1 FROM mv WHERE (mv.s, mv.d, mv.typ, mv.v, mv.g) = (fresh.s, fresh.d, fresh.typ, fresh.v, fresh.g))
  UNION ALL SELECT 'move', id, s, typ, d, v, g FROM mv
  UNION ALL SELECT 'remove', id, s, typ, d, v, g FROM k WHERE (hit AND nth > 1) OR (NOT hit AND id NOT IN (SELECT id FROM mv)))"""
_AXIOMS = f"""ax AS (SELECT p_partkey + {t.PART} AS concept_id, CASE WHEN p_size >= 25 THEN 'EquivalentClasses(:' ELSE 'SubClassOf(:' END || (p_partkey + {t.PART})::VARCHAR
  || ' ObjectIntersectionOf(:{t.PART} ObjectSomeValuesFrom(:{ROLE_GROUP} ObjectIntersectionOf(ObjectSomeValuesFrom(:101 :' || {_B}::VARCHAR || ') ObjectSomeValuesFrom(:102 :'
  || {_Y}::VARCHAR || '))) DataHasValue(:103 "' || p_size::VARCHAR || '"^^xsd:integer)))' AS axiom FROM part)"""
_WIDE = f"""p AS (SELECT p_partkey + {t.PART} AS part, {_B} AS b, {_Y} AS y, {_S} AS s FROM part),
d AS (SELECT DISTINCT {1 << 40} + {_digits('b::VARCHAR')} AS concept, b, NULL::BIGINT AS y, NULL::BIGINT AS s, 1 AS w FROM p
  UNION SELECT DISTINCT {2 << 40} + {_digits("b::VARCHAR || '|' || y::VARCHAR")}, b, y, NULL, 2 FROM p
  UNION SELECT DISTINCT {3 << 40} + {_digits("b::VARCHAR || '|' || y::VARCHAR || '|' || s::VARCHAR")}, b, y, s, 3 FROM p),
everything AS (SELECT concept, b, y, s FROM d UNION ALL SELECT part, b, y, s FROM p),
sub AS (SELECT e.concept AS child, d.concept AS ancestor FROM everything e JOIN d ON e.b = d.b AND (d.y IS NULL OR e.y = d.y) AND (d.s IS NULL OR e.s = d.s) WHERE e.concept <> d.concept)"""

SQL = {
    "latest_state_merge": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "streamed_states": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "snapshot_delta_overlay": f"""
SELECT o_custkey, o_orderkey, o_orderstatus, source_rank::BIGINT AS source_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY source_rank DESC, o_orderdate DESC, o_orderkey DESC) AS r
  FROM (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN 0 ELSE 1 END AS source_rank FROM orders)) WHERE r = 1 AND o_orderstatus <> 'F'""",
    "definition_status_split": f"SELECT p_partkey + {t.PART} AS concept_id, p_size >= 25 AS defined, p_size < 25 AS \"primitive\" FROM part",
    "orphan_sources": "SELECT DISTINCT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "relationship_projection": f"""
SELECT l_orderkey + {t.ORDER} AS source_id, l_suppkey + {t.SUPPLIER} AS destination_id, l_linenumber::BIGINT AS relationship_group,
  l_linestatus = 'O' AS stated, l_returnflag = 'R' AS universal FROM lineitem WHERE l_returnflag <> 'A'""",
    "concrete_value_parse": f"""
WITH v AS (SELECT p_partkey + {t.PART} AS concept_id, unnest(['#' || p_size::VARCHAR, '#' || p_size::VARCHAR || '.50', '"' || p_brand || '"']) AS value, unnest([0, 1, 2])::BIGINT AS pos FROM part)
SELECT concept_id, pos, value, CASE WHEN value LIKE '#%.%' THEN 'DECIMAL' WHEN value LIKE '#%' THEN 'INTEGER' ELSE 'STRING' END AS kind,
  CASE WHEN value LIKE '#%' THEN substr(value, 2) ELSE regexp_replace(regexp_replace(value, '^"', ''), '"$', '') END AS text, value AS rendered FROM v""",
    "stated_isa_closure": f"WITH RECURSIVE {_EDGES}, {_CLOSED.format(e='e')} SELECT child::BIGINT AS child, ancestor::BIGINT AS ancestor FROM x",
    "descendants_of": f"WITH RECURSIVE {_EDGES}, x(node) AS (SELECT child FROM e WHERE parent = {t.REGION + 1} UNION SELECT e.child FROM x JOIN e ON e.parent = x.node) SELECT node::BIGINT AS node FROM x",
    "direct_parents_reduction": f"""
WITH RECURSIVE {_SHORT}, {_CLOSED.format(e='s')}
SELECT child::BIGINT AS child, ancestor::BIGINT AS parent FROM x WHERE NOT EXISTS (SELECT 1 FROM x a JOIN x b ON a.ancestor = b.child WHERE a.child = x.child AND b.ancestor = x.ancestor)""",
    "hierarchy_levels": f"""
WITH RECURSIVE {_SHORT}, y(node, level) AS (SELECT DISTINCT parent, 0 FROM s WHERE parent NOT IN (SELECT child FROM s)
  UNION SELECT s.child, y.level + 1 FROM y JOIN s ON s.parent = y.node)
SELECT node::BIGINT AS node, max(level)::BIGINT AS level FROM y GROUP BY node""",
    "equivalent_sets": f"""
SELECT set_id, member FROM (SELECT o_orderkey + {t.ORDER} AS member, min(o_orderkey + {t.ORDER}) OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus) AS set_id,
  count(*) OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus) AS n FROM orders) WHERE n > 1""",
    "ungrouped_roles_default": f"""
WITH r AS (SELECT DISTINCT o_custkey + {t.CUSTOMER} AS ct, substr(o_orderpriority, 1, 1)::BIGINT AS att FROM orders WHERE o_orderstatus = 'P'),
k AS (SELECT c_nationkey + {t.NATION} AS ct, c_custkey + {t.CUSTOMER} AS child FROM customer),
c AS (SELECT ct FROM k UNION SELECT child FROM k),
f AS (SELECT c.ct, att FROM c JOIN r USING (ct) UNION SELECT k.ct, att FROM k JOIN r ON r.ct = k.child)
SELECT ct::BIGINT AS content_type_id, att::BIGINT AS attribute_id FROM f
UNION ALL SELECT ct::BIGINT, unnest({list(DEFAULT_UNGROUPED)})::BIGINT FROM c WHERE ct NOT IN (SELECT ct FROM f)""",
    "role_group_rows": """
SELECT l_orderkey AS source_id, l_linenumber::BIGINT AS relationship_group, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS destinations, count(*)::BIGINT AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "role_group_numbering": """
WITH r AS (SELECT DISTINCT l_orderkey AS source_id, l_suppkey AS part, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END AS g FROM lineitem)
SELECT source_id, part, g::BIGINT AS old_group, (CASE WHEN g = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY source_id, g <> 0 ORDER BY part, g) END)::BIGINT AS new_group FROM r""",
    "fragment_subsumption": f"""
WITH RECURSIVE {_EDGES}, {_CLOSED.format(e='e')}, {_ATTRIBUTES},
u AS (SELECT child, ancestor FROM x UNION SELECT dest, dest FROM r)
SELECT DISTINCT a.owner, a.id AS row_l, b.id AS row_r FROM r a JOIN r b ON a.owner = b.owner AND a.typ >= b.typ JOIN u ON u.child = a.dest AND u.ancestor = b.dest WHERE a.id <> b.id""",
    "concrete_subsumption": f"""
WITH r AS (SELECT DISTINCT l_orderkey + {t.ORDER} AS owner, 1 + l_linenumber % 2 AS typ, l_quantity::BIGINT AS v, l_partkey * 100 + l_linenumber * 10 + 1 + l_linenumber % 2 AS id FROM lineitem)
SELECT DISTINCT a.owner, a.id AS row_l, b.id AS row_r FROM r a JOIN r b ON a.owner = b.owner AND a.v = b.v AND a.typ >= b.typ WHERE a.id <> b.id""",
    "property_chain_closure": f"""
SELECT DISTINCT l_partkey + {t.PART} AS part_id, unnest([n_nationkey + {t.NATION}, n_regionkey + {t.REGION}])::BIGINT AS located_in
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "group_containment": f"WITH {_FLAGS} SELECT owner, strong, weak FROM c",
    "group_antichain": f"""
WITH {_FLAGS} SELECT owner, grp, n::BIGINT AS n FROM z WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.owner = z.owner AND c.weak = z.grp
  AND (c.strong < c.weak OR NOT EXISTS (SELECT 1 FROM c b WHERE b.owner = c.owner AND b.strong = c.weak AND b.weak = c.strong)))""",
    "inherited_attributes": f"""
WITH RECURSIVE {_EDGES}, {_CLOSED.format(e='e')}, o(node, attribute) AS (SELECT r_regionkey + {t.REGION}, r_name FROM region UNION ALL SELECT n_nationkey + {t.NATION}, n_name FROM nation)
SELECT node::BIGINT AS concept_id, attribute FROM o UNION SELECT x.child::BIGINT, attribute FROM x JOIN o ON x.ancestor = o.node""",
    "relationship_diff": f'WITH {_DIFF} SELECT action, id, s AS source_id, typ AS "typeId", d AS destination_id, v AS value, g AS grp FROM delta',
    "group_zero_move": f"WITH {_DIFF} SELECT id, s AS source_id, g AS new_group FROM delta WHERE action = 'move'",
    "change_counts": f"WITH {_DIFF} SELECT action, count(*)::BIGINT AS n FROM delta GROUP BY action",
    "archive_round_trip": f"""
SELECT p_partkey + {t.PART} AS id, true AS active, (CASE WHEN p_size >= 25 THEN {DEFINED} ELSE {PRIMITIVE} END)::BIGINT AS other, 0::BIGINT AS grp FROM part
UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_linestatus = 'O', l_partkey + {t.PART}, l_linenumber::BIGINT FROM lineitem""",
    "retired_id_reuse": """
WITH p AS (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F')
SELECT o.o_orderkey, o.o_custkey, p.o_orderkey AS reused_id FROM orders o LEFT JOIN p ON p.r = 1 AND p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority WHERE o.o_orderstatus = 'O'""",
    "inactivation_retirement": "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')",
    "class_axiom_text": f"WITH {_AXIOMS} SELECT concept_id, axiom FROM ax",
    "axiom_signature": f"WITH {_AXIOMS} SELECT concept_id, unnest(list_distinct(regexp_extract_all(axiom, ':([0-9]+)', 1)))::BIGINT AS named_id FROM ax",
    "axiom_round_trip": f"WITH {_AXIOMS} SELECT concept_id, axiom FROM ax",
    "property_flags_merge": """
WITH r AS (SELECT DISTINCT user_id, event_type FROM events),
a AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'TransitiveObjectProperty(:' || user_id || ')' WHEN 'view' THEN 'ReflexiveObjectProperty(:' || user_id || ')'
  ELSE 'SubObjectPropertyOf(ObjectPropertyChain(:1 :2) :' || user_id || ')' END AS x FROM r)
SELECT user_id, bool_or(starts_with(x, 'Trans')) AS transitive, bool_or(starts_with(x, 'Refl')) AS reflexive, bool_or(starts_with(x, 'SubObj')) AS chain,
  array_to_string(list_sort(list_distinct(list(x))), chr(10)) AS axioms FROM a GROUP BY user_id""",
    "description_annotations": """
WITH d AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL),
m AS (SELECT *, max(n) OVER (PARTITION BY lang) AS most FROM d),
k AS (SELECT lang, sum((n = most)::INT)::BIGINT AS preferred, list_sort(list_distinct(list(CASE WHEN source = 'src0' THEN '' ELSE replace(source, 'src', 'x') END) FILTER (n = most))) AS dialects FROM m GROUP BY lang)
SELECT lang, preferred, CASE WHEN preferred = 1 AND len(dialects) = 1 AND dialects[1] <> '' THEN lang || '-' || dialects[1] ELSE lang END AS tag FROM k""",
    "acceptability_map": """
SELECT doc_id, lang, array_to_string(list_filter([CASE WHEN quality = 1 THEN 'quality=1' END, CASE WHEN toxic = 1 THEN 'toxic=1' END], lambda x: x IS NOT NULL), ',') AS acceptability
FROM documents JOIN labels USING (doc_id) WHERE quality = 1 OR toxic = 1""",
    "el_classification": f"WITH {_WIDE} SELECT child::BIGINT AS child, ancestor::BIGINT AS ancestor FROM sub",
    "stated_retirement_rows": f"""
SELECT l_orderkey + {t.ORDER} AS source_id, concat_ws(chr(9), l_orderkey + {t.ORDER}, '', '0', l_suppkey, l_partkey + {t.PART}, l_linenumber, {IS_A}) AS row_text
FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O'""",
    "reconcile_axioms": f"""
WITH f AS (SELECT o_custkey, o_orderdate < TIMESTAMP '{CUTOFF}' AS old, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderdate < TIMESTAMP '{CUTOFF}' ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
p AS (SELECT o_custkey, o_orderpriority AS published FROM f WHERE old AND r = 1), c AS (SELECT o_custkey, o_orderpriority AS current FROM f WHERE NOT old AND r = 1)
SELECT o_custkey, published, current, CASE WHEN published IS NULL THEN 'new' WHEN current IS NULL THEN 'missing' WHEN published = current THEN 'unchanged' ELSE 'modified' END AS status
FROM p FULL JOIN c USING (o_custkey)""",
    "concept_extract": """
SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""",
    "el_roles_and_chains": f"""
WITH w(c, place) AS (SELECT s_suppkey + {t.SUPPLIER}, s_nationkey FROM supplier UNION ALL SELECT c_custkey + {t.CUSTOMER}, c_nationkey FROM customer
  UNION ALL SELECT n_nationkey + {t.NATION}, n_nationkey FROM nation UNION ALL SELECT n_nationkey + {t.NATION + LOCAL}, n_nationkey FROM nation),
x AS (SELECT c AS child, n_nationkey + {t.NATION + LOCAL} AS ancestor FROM w JOIN nation ON place = n_nationkey
  UNION SELECT c, n_regionkey + {t.REGION + LOCAL} FROM w JOIN nation ON place = n_nationkey
  UNION SELECT r_regionkey + {t.REGION}, r_regionkey + {t.REGION + LOCAL} FROM region)
SELECT child::BIGINT AS child, ancestor::BIGINT AS ancestor FROM x WHERE child <> ancestor""",
    "normal_form_attributes": f"""
WITH c AS (SELECT c_custkey + {t.CUSTOMER} AS id, c_nationkey + {t.NATION} AS place, '#' || c_nationkey AS v, c_mktsegment AS m, c_acctbal >= 0 AS rich FROM customer),
x(id, grp, typ, dest, v) AS (SELECT r_regionkey + {t.REGION}, 0, 1, r_regionkey + {t.REGION}, NULL FROM region
  UNION ALL SELECT n_nationkey + {t.NATION}, 0, 1, n_nationkey + {t.NATION}, NULL FROM nation
  UNION ALL SELECT s_suppkey + {t.SUPPLIER}, 0, 2, s_nationkey + {t.NATION}, NULL FROM supplier
  UNION ALL SELECT id, 0, 1, place, NULL FROM c WHERE NOT rich
  UNION ALL SELECT id, 1, 2, place, NULL FROM c WHERE rich
  UNION ALL SELECT id, 1, 3, NULL, v FROM c WHERE rich
  UNION ALL SELECT id, 2, 4, {t.BRAND} + length(m), NULL FROM c WHERE rich AND m = 'BUILDING')
SELECT id::BIGINT AS "conceptId", grp::BIGINT AS grp, typ::BIGINT AS "typeId", dest::BIGINT AS "destinationId", v AS value FROM x""",
    "cycle_members": f"""
WITH RECURSIVE o AS (SELECT o_custkey + {t.CUSTOMER} AS c, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'),
e(child, parent) AS (SELECT DISTINCT a.c, b.c FROM o a JOIN o b ON b.n = a.n + 1 WHERE a.n % 25 <> 0 AND a.c <> b.c),
x(a, b) AS (SELECT child, parent FROM e UNION SELECT x.a, e.parent FROM x JOIN e ON x.b = e.child)
SELECT least(x.a, min(x.b))::BIGINT AS set_id, x.a::BIGINT AS member FROM x WHERE a <> b AND EXISTS (SELECT 1 FROM x y WHERE y.a = x.b AND y.b = x.a) GROUP BY x.a""",
    "numbered_orders": """
SELECT o_orderkey, o_orderkey * 10 AS id FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT o_orderkey, -(n * 10 + n % 7) FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderpriority <> '1-URGENT')""",
    "chain_normal_form": f"""
SELECT n_nationkey + {t.NATION} AS "conceptId", 0::BIGINT AS grp, 3::BIGINT AS "typeId", n_regionkey + {t.REGION} AS "destinationId", false AS universal FROM nation
UNION ALL SELECT s_suppkey + {t.SUPPLIER}, 1, 1, s_nationkey + {t.NATION}, false FROM supplier
UNION ALL SELECT c_custkey + {t.CUSTOMER}, unnest([1, 2]), unnest([1, 3]), c_nationkey + {t.NATION}, false FROM customer
UNION ALL SELECT c_custkey + {t.CUSTOMER}, 3, 1, n_regionkey + {t.REGION}, true FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'""",
    "stable_group_numbers": f"""
SELECT DISTINCT l_orderkey + {t.ORDER} AS "conceptId", (50 - l_linenumber)::BIGINT AS grp, l_linenumber::BIGINT AS "typeId", l_partkey + {t.PART} AS "destinationId" FROM lineitem""",
    "generated_axioms": f"""
WITH {_EDGES}, u(child, parent) AS (SELECT child, parent FROM e UNION ALL SELECT r_regionkey + {t.REGION}, {t.REGION - 1} FROM region),
k AS (SELECT c_custkey + {t.CUSTOMER} AS child, c_nationkey + {t.NATION} AS place FROM customer WHERE c_acctbal >= 0),
a AS (SELECT child AS component, 'SubClassOf(:' || child || ' ' || CASE WHEN place IS NULL THEN ':' || parent
    ELSE 'ObjectIntersectionOf(:' || parent || ' ObjectSomeValuesFrom(:{ROLE_GROUP} ObjectSomeValuesFrom(:{MARKET} :' || place || ')))' END || ')' AS axiom FROM u LEFT JOIN k USING (child)
  UNION ALL SELECT {MODEL_ATTRIBUTE}, 'SubClassOf(:{MODEL_ATTRIBUTE} :{t.REGION - 1})'
  UNION ALL SELECT {OBJECT_ATTRIBUTE}, 'SubClassOf(:{OBJECT_ATTRIBUTE} :{MODEL_ATTRIBUTE})'
  UNION ALL SELECT {MARKET}, 'SubObjectPropertyOf(:{MARKET} :{OBJECT_ATTRIBUTE})')
SELECT component::BIGINT AS component, axiom FROM a""",
    "release_delta": f"""
SELECT CASE WHEN c_acctbal >= 0 THEN 'move' ELSE 'remove' END AS action, (c_custkey + {t.CUSTOMER})::BIGINT AS source_id, {MARKET}::BIGINT AS "typeId",
  (c_nationkey + {t.NATION})::BIGINT AS destination_id, (CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END)::BIGINT AS grp FROM customer""",
    "classification_delta": f"""
WITH {_WIDE}, par AS (SELECT child, ancestor FROM sub s WHERE child < {1 << 40} AND NOT EXISTS (SELECT 1 FROM sub a JOIN sub b ON a.ancestor = b.child WHERE a.child = s.child AND b.ancestor = s.ancestor)),
old AS (SELECT part, part - {t.PART} AS id, {2 << 40} + {_digits("b::VARCHAR || '|' || y::VARCHAR")} AS dest FROM p)
SELECT 'add' AS action, NULL::BIGINT AS id, child::BIGINT AS source_id, ancestor::BIGINT AS destination_id FROM par WHERE NOT EXISTS (SELECT 1 FROM old WHERE part = child AND dest = ancestor)
UNION ALL SELECT 'remove', id, part, dest FROM old WHERE NOT EXISTS (SELECT 1 FROM par WHERE child = part AND ancestor = dest)""",
}
