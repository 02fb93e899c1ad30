"""Axiom texts and their rows: rendering by aggregates, parsing by a small reader in Arrow batches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalith.functions import values
from vocalith.schema import IS_A, LEGACY_ROLE_GROUP, ROLE_GROUP

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"(?:\^\^(?:<[^>]*>|[^\s()]+))?|<[^>]*>|[()]|[^\s()"]+')
#: Kinds of axiom that convert to rows; others have none.
SUB_PROPERTY = ("SubObjectPropertyOf", "SubDataPropertyOf", "SubAnnotationPropertyOf")
CONVERTIBLE = ("SubClassOf", "EquivalentClasses", *SUB_PROPERTY)


# -- rendering -------------------------------------------------------------------------------------------------------


def _id(c: Column) -> Column:
    return F.concat(F.lit(":"), c.cast("string"))


def _call(name: str, *args: Column) -> Column:
    return F.concat(F.lit(f"{name}("), F.concat_ws(" ", *args), F.lit(")"))


def _joined(terms: Column) -> Column:
    """One term as it is, several as an intersection, in order of kind and text."""
    texts = F.transform(F.sort_array(terms), lambda x: x["text"])
    return F.when(F.size(texts) == 1, texts[0]).otherwise(F.concat(F.lit("ObjectIntersectionOf("), F.array_join(texts, " "), F.lit(")")))


def class_expressions(rows: DataFrame, ungrouped: DataFrame | None = None) -> DataFrame:
    """conceptId, expression of rows (conceptId, grp, typeId, destinationId, kind, text).

    Is-a rows name classes; a role that is never grouped stands bare whatever its group; a row of group 0 is a role
    group of its own; rows of another group are one role group.
    """
    bare = rows.withColumn("bare_", F.lit(False))
    if ungrouped is not None:
        bare = rows.join(ungrouped.select(F.col("attributeId").alias("typeId"), F.lit(True).alias("bare_")).distinct(), "typeId", "left")
    is_a = F.col("typeId") == IS_A
    one = F.col("destinationId").isNotNull() != F.col("text").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("a row needs either a destination or a value: "), F.col("conceptId").cast("string")))
    bare = bare.withColumn("destinationId", F.when(one, F.col("destinationId")).otherwise(wrong.cast("long")))
    term = F.when(is_a, F.struct(F.lit(0).alias("o"), _id(F.col("destinationId")).alias("text"))).when(
        F.col("destinationId").isNotNull(),
        F.struct(F.lit(1).alias("o"), _call("ObjectSomeValuesFrom", _id(F.col("typeId")), _id(F.col("destinationId"))).alias("text")),
    ).otherwise(F.struct(F.lit(2).alias("o"), _call("DataHasValue", _id(F.col("typeId")), values.literal(F.col("kind"), F.col("text"))).alias("text")))
    single = is_a | F.coalesce(F.col("bare_"), F.lit(False))
    flat = bare.select("conceptId", "grp", term.alias("term"), single.alias("single_"))
    wrap = lambda t: F.struct(F.lit(1).alias("o"), _call("ObjectSomeValuesFrom", F.lit(f":{ROLE_GROUP}"), t).alias("text"))
    grouped = flat.filter("not single_ and grp <> 0").groupBy("conceptId", "grp").agg(_joined(F.collect_set("term")).alias("t"))
    outer = (
        flat.filter("single_").select("conceptId", "term")
        .unionByName(flat.filter("not single_ and grp = 0").select("conceptId", wrap(F.col("term.text")).alias("term")))
        .unionByName(grouped.select("conceptId", wrap(F.col("t")).alias("term")))
    )
    return outer.groupBy("conceptId").agg(_joined(F.collect_set("term")).alias("expression"))


def class_axioms(expressions: DataFrame, defined: DataFrame) -> DataFrame:
    """conceptId, axiom: SubClassOf for primitive concepts, EquivalentClasses for those in `defined` (conceptId)."""
    marked = expressions.join(defined.select("conceptId", F.lit(True).alias("defined_")), "conceptId", "left")
    both = [_id(F.col("conceptId")), F.col("expression")]
    return marked.select("conceptId", F.when(F.col("defined_"), _call("EquivalentClasses", *both)).otherwise(_call("SubClassOf", *both)).alias("axiom"))


def concept_axioms(rows: DataFrame, defined: DataFrame, attributes: DataFrame, ungrouped: DataFrame | None = None) -> DataFrame:
    """conceptId, axiom of rows as class_expressions has them, for any concept.

    A concept with a parent among attributes (id, kind; SubObjectPropertyOf and so on) is a property below that parent.
    ValueError if a concept has no is-a row in group 0.
    """
    parents = rows.filter((F.col("grp") == 0) & (F.col("typeId") == IS_A)).select("conceptId", "destinationId")
    bare = rows.select("conceptId").distinct().join(parents, "conceptId", "left_anti").limit(1).collect()
    if bare:
        raise ValueError(f"concept {bare[0].conceptId} has no is-a relationship in group 0")
    known = attributes.select(F.col("id").alias("destinationId"), F.col("kind").alias("kind_"))
    first = parents.join(known, "destinationId").groupBy("conceptId").agg(F.min(F.struct("destinationId", "kind_")).alias("p"))
    text = F.concat(F.col("p.kind_"), F.lit("(:"), F.col("conceptId").cast("string"), F.lit(" :"), F.col("p.destinationId").cast("string"), F.lit(")"))
    others = rows.join(first.select("conceptId"), "conceptId", "left_anti").select(rows.columns)
    return first.select("conceptId", text.alias("axiom")).unionByName(class_axioms(class_expressions(others, ungrouped), defined))


def sub_property_axioms(edges: DataFrame, kind: str) -> DataFrame:
    """conceptId, axiom of (child, parent)."""
    return edges.select(F.col("child").alias("conceptId"), _call(kind, _id(F.col("child")), _id(F.col("parent"))).alias("axiom"))


# -- reading ---------------------------------------------------------------------------------------------------------


def read(text: str):
    """Nested (name, *operands) of one functional-syntax expression; identifiers as ints. ValueError if it isn't one."""
    tokens = TOKEN.findall(text.replace(f":{LEGACY_ROLE_GROUP}", f":{ROLE_GROUP}"))
    at = 0

    def term():
        nonlocal at
        if at >= len(tokens) or tokens[at] in "()":
            raise ValueError(f"an operand is missing in {text!r}")
        name = tokens[at]
        at += 1
        if at < len(tokens) and tokens[at] == "(":
            at += 1
            operands = []
            while at < len(tokens) and tokens[at] != ")":
                operands.append(term())
            if at == len(tokens):
                raise ValueError(f"a bracket isn't closed in {text!r}")
            at += 1
            return (name, *operands)
        if m := re.fullmatch(r":(\d+)|<[^>]*/(\d+)>", name):
            return int(m[1] or m[2])
        return name

    found = term()
    if at != len(tokens) or not isinstance(found, tuple):
        raise ValueError(f"not one axiom: {text!r}")
    return found


def value(token: str) -> tuple[str, str]:
    """(kind, text) of a typed literal."""
    m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"\^\^<?\S*?(?:#|:)(decimal|integer|string)>?', token)
    if not m:
        raise ValueError(f"not a decimal, integer or string: {token}")
    return m[2].upper(), m[1]


def rows_of(expression, group: int):
    """[(group, type, destination, kind, text)] of a class expression, and the next free group."""
    if not isinstance(expression, tuple) or expression[0] != "ObjectIntersectionOf":
        raise ValueError("an intersection is expected")
    out = []
    for x in expression[1:]:
        if isinstance(x, int):
            out.append((0, IS_A, x, None, None))
        elif x[0] == "ObjectSomeValuesFrom" and x[1] == ROLE_GROUP:
            inner = x[2][1:] if x[2][0] == "ObjectIntersectionOf" else (x[2],)
            out += [attribute(y, group) for y in inner]
            group += 1
        else:
            out.append(attribute(x, 0))
    return out, group


def attribute(x, group: int):
    if isinstance(x, tuple) and x[0] == "ObjectSomeValuesFrom":
        if not isinstance(x[2], int):
            raise ValueError("the value of an attribute must be a named class")
        return (group, x[1], x[2], None, None)
    if isinstance(x, tuple) and x[0] == "DataHasValue":
        return (group, x[1], None, *value(x[2]))
    raise ValueError(f"not an attribute: {x}")


def convert(text: str, group: int = 1, skip_gci: bool = False):
    """(primitive, left concept, left rows, right concept, right rows, next group), or None for other axioms."""
    name, *operands = read(text)
    if name in SUB_PROPERTY:
        child, parent = operands
        if not isinstance(child, int):  # a chain
            return None
        return True, child, [], None, [(0, IS_A, parent, None, None)], group
    if name not in ("SubClassOf", "EquivalentClasses"):
        return None
    if len(operands) != 2:
        raise ValueError("two class expressions are expected")
    left, right = operands
    if name == "EquivalentClasses" and not isinstance(left, int):
        left, right = right, left
    if not isinstance(left, int):
        if skip_gci:
            return None
        if not isinstance(right, int):
            raise ValueError("one side must be a named class")
        return name == "SubClassOf", None, rows_of(left, 1)[0], right, [], group
    if isinstance(right, int):
        return name == "SubClassOf", left, [], right, [(0, IS_A, right, None, None)], group
    rows, group = rows_of(right, group)
    return name == "SubClassOf", left, [], None, rows, group


CONVERTED = (
    "axiom_id string, component long, axiom_type string, primitive boolean, left_concept long, right_concept long, side string, "
    "grp int, ord int, typeId long, destinationId long, kind string, text string, error string"
)


def relationships(axioms: DataFrame, skip_gci: bool = False) -> DataFrame:
    """A row for each relationship of axioms (axiom_id, component, axiom); error is set where a text can't be converted.

    The axioms of a component share their group numbers: they are brought together, and numbered in order of axiom_id.
    """

    names = [c.split()[0] for c in CONVERTED.split(", ")]

    def convert_all(batches):
        import pandas as pd

        component, group = None, 1
        for batch in batches:
            out = []
            for a in batch.itertuples():
                if a.component != component:
                    component, group = a.component, 1
                head = (a.axiom_id, a.component, a.axiom.split("(", 1)[0].strip())
                try:
                    found = convert(a.axiom, group, skip_gci)
                except (ValueError, IndexError, TypeError) as e:
                    out.append((*head, *[None] * 10, str(e) or "unreadable"))
                    continue
                if found is None:
                    continue
                primitive, left, left_rows, right, right_rows, group = found
                for side, part in (("left", left_rows), ("right", right_rows)):
                    out += [(*head, primitive, left, right, side, r[0], i, *r[1:], None) for i, r in enumerate(part)]
            frame = pd.DataFrame(out, columns=names, dtype=object)
            yield frame.astype({c: "Int64" for c in ("component", "left_concept", "right_concept", "typeId", "destinationId", "grp", "ord")})

    ordered = axioms.select("axiom_id", "component", "axiom").repartition("component").sortWithinPartitions("component", "axiom_id")
    return ordered.mapInPandas(convert_all, CONVERTED)


def object_id(text: str) -> int:
    """A negative number for an expression, the same wherever it stands."""
    import xxhash

    return -(xxhash.xxh64_intdigest(text.encode()) >> 1) - 1


NORMAL = "rule string, a long, b long, c long, n int"


def normal_rows(text: str):
    """told(a, b), member(a of intersection b, n), exists(a = role b some c), role(a, b), chain(a, b, c), reflexive(a)."""
    out = []

    def class_id(x) -> int:
        if isinstance(x, int):
            return x
        if isinstance(x, str):
            return object_id(x)
        if x[0] == "ObjectIntersectionOf":
            members = sorted({class_id(y) for y in x[1:]})
            if len(members) == 1:
                return members[0]
            me = object_id(f"and {members}")
            for m in members:
                out.extend([("told", me, m, None, None), ("member", m, me, None, len(members))])
            return me
        if x[0] in ("ObjectSomeValuesFrom", "DataHasValue"):
            role, filler = x[1], class_id(x[2])
            me = object_id(f"some {role} {filler}")
            out.append(("exists", me, role, filler, None))
            return me
        raise ValueError(f"not a class expression: {x[0]}")

    name, *operands = read(text)
    if name == "SubClassOf":
        out.append(("told", class_id(operands[0]), class_id(operands[1]), None, None))
    elif name == "EquivalentClasses":
        ids = [class_id(x) for x in operands]
        out.extend(("told", i, j, None, None) for i in ids for j in ids if i != j)
    elif name in SUB_PROPERTY:
        sub, sup = operands
        if isinstance(sub, int):
            out.append(("role", sub, sup, None, None))
        elif len(sub) == 3:
            out.append(("chain", sub[1], sub[2], sup, None))
        else:
            raise ValueError("a chain has two links")
    elif name == "TransitiveObjectProperty":
        out.append(("chain", operands[0], operands[0], operands[0], None))
    elif name == "ReflexiveObjectProperty":
        out.append(("reflexive", operands[0], None, None, None))
    return out


def normalised(axioms: DataFrame) -> DataFrame:
    """The normal form of axioms (column axiom) as rows; each axiom by itself."""

    def normal(batches):
        import pandas as pd

        for batch in batches:
            out = [r for text in batch["axiom"] for r in normal_rows(text)]
            # as objects: numbers beside missing ones must not become floats
            frame = pd.DataFrame(out, columns=["rule", "a", "b", "c", "n"], dtype=object)
            yield frame.astype({"a": "Int64", "b": "Int64", "c": "Int64", "n": "Int32"})

    return axioms.select("axiom").mapInPandas(normal, NORMAL).distinct()


def check_names(normal: DataFrame) -> None:
    """ValueError if two expressions have one number, which would make them one class: one aggregate over the normal form."""
    some = normal.filter("rule = 'exists'").groupBy(F.col("a").alias("x")).agg(F.count_distinct(F.struct("b", "c")).alias("n"), F.lit(1).cast("int").alias("need"))
    all_ = normal.filter("rule = 'member'").groupBy(F.col("b").alias("x")).agg(F.count_distinct("a").alias("n"), F.max("n").alias("need"))
    both = some.unionByName(all_).groupBy("x").agg(F.max(F.col("n") != F.col("need")).alias("wrong"), F.count(F.lit(1)).alias("kinds"))
    if bad := both.filter("wrong or kinds > 1").select("x").limit(1).collect():
        raise ValueError(f"two expressions have the number {bad[0].x}")
