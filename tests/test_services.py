"""Services over releases of our own making: one classification with a scenario for each kind of change, and the conversions."""

import zipfile
from datetime import date

import pytest

from tests.test_releases import BASE, CONCEPTS, DELTA, M, NAMES, SITE, edge, write
from vocalith.functions import axioms
from vocalith.operators import classify
from vocalith.plans import ontology, services
from vocalith.schema import AXIOM_REFSET, EXISTENTIAL, INFERRED, IS_A, PRIMITIVE, ROOT, STATED
from vocalith.sources import releases, sinks

OBJECT, DATA, ATTRIBUTE, NOTE = 762705008, 762706009, 410662002, 1295447006
CAUSE, HAS, OF, PART, DOSE, REMARK = 5011, 5020, 5021, 5030, 5040, 5050
DEFINED_, OTHER = 900000000000073002, 999


def concept(i, status=PRIMITIVE, active=1):
    return (i, "", active, M, status)


def axiom(i, c, text):
    return (f"ax{i}", "", 1, M, AXIOM_REFSET, c, text)


def group(*attributes):
    inner = " ".join(attributes)
    return f"ObjectSomeValuesFrom(:609096000 {inner if len(attributes) == 1 else f'ObjectIntersectionOf({inner})'})"


def some(t, d):
    return f"ObjectSomeValuesFrom(:{t} :{d})"


def dose(n):
    return f'SubClassOf(:60 ObjectIntersectionOf(:12 {group(f"""DataHasValue(:{DOSE} "{n}"^^xsd:integer)""")}))'


BASE_MORE = {
    "concept": [*CONCEPTS, *[(c, 20200101, 1, M, PRIMITIVE) for c in (DATA, DOSE, 60, 80)]],
    "stated": [*BASE["stated"], edge(150, DATA, ATTRIBUTE, STATED), edge(151, DOSE, DATA, STATED), edge(152, 80, 12, STATED)],
    "relationship": [
        *BASE["relationship"], edge(250, DATA, ATTRIBUTE, INFERRED), edge(251, DOSE, DATA, INFERRED), edge(280, 80, 12, INFERRED), edge(260, 60, 12, INFERRED),
        edge(281, 998, 12, INFERRED), (399, 20200101, 1, OTHER, 13, 12, 0, IS_A, INFERRED, EXISTENTIAL),
    ],
    "concrete": [(690, 20200101, 1, M, 60, "#1", 1, DOSE, INFERRED, EXISTENTIAL)],
    "ontology": BASE["ontology"],
    "axiom": [("ax60", 20200101, 1, M, AXIOM_REFSET, 60, dose(1))],
    "description": BASE["description"],
}
CHANGES = {
    "concept": [concept(c, DEFINED_ if c in (20, 45, 46) else PRIMITIVE, 0 if c == 80 else 1) for c in (14, 20, CAUSE, 30, 31, HAS, OF, 40, 41, 42, 44, 45, 46, PART, 50, 51, 52, 70, 80, NOTE, REMARK)],
    "stated": [
        edge(180, 14, 13, STATED),  # a new kind, which inherits
        edge(181, 20, 12, STATED), edge(182, 20, 11, STATED, SITE),  # defined as another concept is
        edge(183, CAUSE, OBJECT, STATED), edge(184, 30, 12, STATED), edge(185, 31, 12, STATED), edge(186, 31, 11, STATED, CAUSE),  # below another by a general inclusion
        edge(187, HAS, OBJECT, STATED), edge(188, OF, OBJECT, STATED), edge(189, 40, ROOT, STATED), edge(192, 42, 40, STATED),
        edge(194, 44, ROOT, STATED), edge(195, 45, 44, STATED), edge(196, 45, 42, STATED, HAS), edge(197, 46, 44, STATED), edge(198, 46, 41, STATED, HAS),  # below another by a chain
        edge(199, PART, OBJECT, STATED), edge(301, 50, 11, STATED), edge(302, 51, 11, STATED), edge(303, 52, 11, STATED),
        edge(304, 51, 50, STATED, PART), edge(305, 52, 51, STATED, PART), edge(306, 52, 50, STATED, PART),  # a part of a part
        edge(307, NOTE, ATTRIBUTE, STATED), edge(308, REMARK, NOTE, STATED),
    ],
    "axiom": [
        axiom(30, 30, f"SubClassOf(ObjectIntersectionOf(:12 {group(some(CAUSE, 11))}) :30)"),
        axiom(20, HAS, f"SubObjectPropertyOf(ObjectPropertyChain(:{HAS} :{OF}) :{HAS})"),
        axiom(41, 41, f"SubClassOf(:41 ObjectIntersectionOf(:40 {some(OF, 42)}))"),
        axiom(21, PART, f"TransitiveObjectProperty(:{PART})"),
        axiom(60, 60, dose(2)),  # another number
        axiom(70, 70, f"SubClassOf(:70 ObjectIntersectionOf(:12 {group(some(SITE, 11))} {group(some(CAUSE, 11))}))"),  # two groups
    ],
}
WANT = {
    ("add", None, 14, 0, IS_A, 13, None), ("add", 295, 14, 0, SITE, 11, None),
    ("add", None, 20, 0, IS_A, 13, None), ("add", None, 20, 0, SITE, 11, None),
    *[("add", None, c, 0, IS_A, p, None) for c, p in ((CAUSE, OBJECT), (30, 12), (31, 30), (HAS, OBJECT), (OF, OBJECT), (40, ROOT), (41, 40), (42, 40), (44, ROOT), (45, 44), (46, 45),
                                                      (PART, OBJECT), (50, 11), (51, 11), (52, 11), (70, 13), (70, 30), (REMARK, NOTE))],
    ("add", None, 31, 0, CAUSE, 11, None), ("add", None, 41, 0, OF, 42, None), ("add", None, 45, 0, HAS, 42, None), ("add", None, 46, 0, HAS, 41, None),
    ("add", None, 51, 0, PART, 50, None), ("add", None, 52, 0, PART, 51, None),
    ("remove", 690, 60, 1, DOSE, None, "#1"), ("add", None, 60, 1, DOSE, None, "#2"),
    ("add", None, 70, 1, SITE, 11, None), ("add", None, 70, 2, CAUSE, 11, None),
    ("remove", 280, 80, 0, IS_A, 12, None), ("remove", 281, 998, 0, IS_A, 12, None), ("remove", 399, 13, 0, IS_A, 12, None),
}


@pytest.fixture(scope="module")
def names():
    NAMES["concrete"] = "sct2_RelationshipConcreteValues_X.txt"


@pytest.fixture(scope="module")
def folders(names, tmp_path_factory):
    top = tmp_path_factory.mktemp("services")
    return write(top / "base", BASE_MORE), write(top / "delta", CHANGES)


def test_a_classification_with_every_kind_of_change(spark, folders, tmp_path):
    result = services.classify(spark, [folders[0]], folders[1])
    found = {(r.action, r.id, r.sourceId, r.grp, r.typeId, r.destinationId, r.value) for r in result.delta.collect()}
    assert found - WANT == set()
    assert WANT - found == set()
    assert {(r.set_id, r.member) for r in result.equivalents.collect()} == {(13, 13), (13, 20)}
    sinks.write_archive(result, tmp_path / "results.zip", date(2020, 2, 1))
    with zipfile.ZipFile(tmp_path / "results.zip") as z:
        lines = {n: z.read(n).decode().splitlines() for n in z.namelist()}
    assert {n: len(x) for n, x in lines.items()} == {
        "RF2/sct2_Relationship_Delta_Classification_20200201.txt": 1 + len(WANT) - 2,
        "RF2/sct2_RelationshipConcreteValues_Delta_Classification_20200201.txt": 3,
        "RF2/der2_sRefset_EquivalentConceptSimpleMapDelta_Classification_20200201.txt": 3,
    }
    assert all(len(x.split("\t")) == (7 if "Equivalent" in n else 10) for n, some_ in lines.items() for x in some_)
    assert "690\t\t0\t\t60\t#1\t1\t5040\t900000000000011006\t900000000000451002" in lines["RF2/sct2_RelationshipConcreteValues_Delta_Classification_20200201.txt"]


def test_nothing_changes_without_a_change(spark, names, tmp_path):
    """The release as it is classified, with its own axioms in place of stated rows."""
    plain = {**BASE, "relationship": [r for r in BASE["relationship"] if r[0] != 295]}
    result = services.classify(spark, [write(tmp_path / "base", plain)])
    assert result.delta.collect() == [] and result.equivalents.isEmpty()


def test_stated_rows_become_axioms(spark, folders, tmp_path):
    base, delta = write(tmp_path / "base", BASE), write(tmp_path / "delta", DELTA | {"axiom": [axiom(9, 14, "SubClassOf(:14 :13)")]})
    retired, made = services.stated_to_owl(spark, base, delta)
    rows = [r.row.split("\t") for r in retired.collect()]
    assert len(rows) == 7 and all(r[2] == "0" and r[1] == "" and len(r) == 10 for r in rows)
    copied = [r.row.split("\t") for r in made.filter("part = 0").collect()]
    assert copied == [["ax9", "", "1", str(M), str(AXIOM_REFSET), "14", "SubClassOf(:14 :13)"]]
    texts = {r.row.split("\t")[6] for r in made.filter("part = 1").collect()}
    assert f"EquivalentClasses(:13 ObjectIntersectionOf(:12 {group(some(SITE, 11))}))" in texts
    assert f"SubObjectPropertyOf(:{SITE} :{OBJECT})" in texts and "SubClassOf(:14 :13)" in texts
    assert len(texts) == 7


def test_generated_axioms_give_the_document_of_stated_rows(spark, names, tmp_path):
    base = write(tmp_path / "base", BASE)
    of = lambda r: [x.line for x in ontology.document(spark, r, version="1").orderBy("place").collect()]
    stated = releases.load(spark, [base])
    rows = [r.row.split("\t") for r in services.stated_to_owl(spark, base)[1].collect()]
    made = {**BASE, "stated": [], "axiom": [(r[0], 20200101, *r[2:]) for r in rows]}
    converted = releases.load(spark, [write(tmp_path / "made", made)])
    lines = of(stated)
    assert lines == of(converted)
    # the layout, from head to end
    assert lines[:8] == ["Prefix(:=<http://id.org/>)", *[f"Prefix({p}:=<{i}>)" for p, i in ontology.PREFIXES.items()], ""]
    assert lines[8:12] == ["", "Ontology(<http://o.org/x>", "<http://o.org/x/version/1>", ""]
    body = [x for x in lines[12:] if x and not x.startswith("#")]
    assert body == [
        *[f"Declaration(Class(:{c}))" for c in sorted(map(str, (ROOT, 11, 12, 13, ATTRIBUTE, OBJECT)))],
        *[f"Declaration(ObjectProperty(:{c}))" for c in sorted(map(str, (SITE, OBJECT, 609096000)))],
        f"SubObjectPropertyOf(:{SITE} :{OBJECT})",
        # classes by id as text, each with its axiom
        f"SubClassOf(:11 :{ROOT})", f"SubClassOf(:12 :{ROOT})", f"EquivalentClasses(:13 ObjectIntersectionOf(:12 {group(some(SITE, 11))}))",
        f"SubClassOf(:{ATTRIBUTE} :{ROOT})", f"SubClassOf(:{OBJECT} :{ATTRIBUTE})",
        ")",
    ]


@pytest.mark.parametrize("rows", [[], [("h", 20200101, 1, M, 762103008, 734147008, "no address")], [("h", 20200101, 1, M, 762103008, 734147008, "Ontology(<http://o.org/x>)"), ("i", 20200101, 1, M, 762103008, 734147008, "Ontology(<http://o.org/y>)")]])
def test_documents_need_one_address_and_some_axioms(spark, names, tmp_path, rows):
    base = write(tmp_path / "base", {**BASE, "ontology": rows})
    with pytest.raises(ValueError, match="address"):
        services.to_owl(spark, [base], labels=False)
    bare = write(tmp_path / "bare", {**BASE, "stated": [], "axiom": []})
    with pytest.raises(ValueError, match="no stated relationships and no axioms"):
        services.to_owl(spark, [bare], labels=False)


def test_axioms_of_stated_rows_keep_ids_when_a_row_leaves_group_0(spark, names, tmp_path):
    """Stated rows are converted, and the release is classified from its axioms alone: a role of group 0 gets a group, and keeps its id."""
    base = write(tmp_path / "base", BASE)
    rows = [r.row.split("\t") for r in services.stated_to_owl(spark, base)[1].collect()]
    converted = {**BASE, "stated": [], "axiom": [(r[0], 20200101, *r[2:]) for r in rows]}
    result = services.classify(spark, [write(tmp_path / "converted", converted)])
    assert [(r.action, r.id, r.sourceId, r.grp, r.typeId, r.destinationId) for r in result.delta.collect()] == [("move", 290, 13, 1, SITE, 11)]
    assert result.counts == {"added": 0, "moved": 1, "removed": 0, "inactivated": 0}


def test_inactive_concepts_have_no_attributes(spark, names, tmp_path):
    base = write(tmp_path / "base", BASE)
    gone = services.classify(spark, [base], write(tmp_path / "gone", {"concept": [concept(13, DEFINED_, 0)]}))
    assert {(r.action, r.id, r.sourceId) for r in gone.delta.collect()} == {("remove", 202, 13), ("remove", 290, 13)}
    assert gone.counts == {"added": 0, "moved": 0, "removed": 0, "inactivated": 2}
    # and is active again: nothing is to be done
    before = write(tmp_path / "before", {**BASE, "concept": [(*c[:2], 0 if c[0] == 13 else 1, *c[3:]) for c in CONCEPTS]})
    back = services.classify(spark, [before], write(tmp_path / "back", {"concept": [concept(13, DEFINED_)]}))
    assert back.delta.isEmpty()


def test_an_extension_converts_its_own_concepts(spark, names, tmp_path):
    base = write(tmp_path / "base", BASE)
    own = {"concept": [(91, 20200101, 1, OTHER, PRIMITIVE)], "stated": [(910, 20200101, 1, OTHER, 91, 12, 0, IS_A, STATED, EXISTENTIAL), (911, 20200101, 1, OTHER, 13, 11, 0, IS_A, STATED, EXISTENTIAL)]}
    made, retired, left = services.stated_to_owl_extension(spark, base, write(tmp_path / "own", own))
    assert [r.row.split("\t")[2:] for r in made.collect()] == [["1", str(OTHER), str(AXIOM_REFSET), "91", "SubClassOf(:91 :12)"]]
    assert [(r.sourceId, r.id, r.row.split("\t")[2]) for r in retired.collect()] == [(91, 910, "0")]
    assert [(r.sourceId, r.id, r.row.split("\t")[2]) for r in left.collect()] == [(13, 911, "1")]


def test_reconciliation_with_what_is_published(spark, names, tmp_path):
    authoring = write(tmp_path / "now", {**BASE, "concept": [*CONCEPTS, (15, 20200101, 1, M, PRIMITIVE)], "stated": [*BASE["stated"], edge(170, 15, 12, STATED)]})
    texts = {r.component: r.axiom for r in ontology.generated_axioms(spark, releases.load(spark, [authoring])).collect()}
    old = {c: t for c, t in texts.items() if c != 15} | {12: "SubClassOf(:12 :11)"}
    published = write(tmp_path / "old", {**BASE, "stated": [], "axiom": [(f"p{c}", 20190101, 1, M, AXIOM_REFSET, c, t) for c, t in old.items()]})
    rows = {tuple(r.row.split("\t")[i] for i in (0, 2, 5, 6)) for r in services.reconcile(spark, authoring, None, published).collect()}
    assert ("p12", "1", "12", texts[12]) in rows  # changed: keeps its published id
    assert {r[2] for r in rows} == {"12", "15"} and len(rows) == 2


def test_axioms_become_stated_rows(spark, names, tmp_path):
    two = f'SubClassOf(:13 ObjectIntersectionOf(:12 {group(f"""DataHasValue(:{DOSE} "1"^^xsd:integer)""", f"""DataHasValue(:{DOSE} "2"^^xsd:integer)""")}))'
    some_ = [axiom(1, 13, two), axiom(2, 13, f"SubClassOf(:13 ObjectIntersectionOf(:11 {group(some(SITE, 11))}))"), axiom(3, 12, "SubClassOf(:14 :13)")]
    base = write(tmp_path / "base", {**BASE, "stated": [], "axiom": [(a[0], 20200101, *a[2:]) for a in some_]})
    rows = [r.row for r in services.axioms_to_stated(spark, [base]).orderBy("sourceId", "grp", "place").collect()]
    assert rows == [
        "\t".join(["1000000020", "", "1", str(M), "13", str(d), str(g), str(t), str(STATED), str(EXISTENTIAL), ""])
        for g, t, d in ((0, IS_A, 12), (0, IS_A, 11), (1, DOSE, -1), (1, DOSE, -1), (2, SITE, 11))
    ]
    bad = write(tmp_path / "bad", {**BASE, "stated": [], "axiom": [("x", 20200101, 1, M, AXIOM_REFSET, 13, "SubClassOf(:13")]})
    with pytest.raises(ValueError, match="axiom x"):
        services.axioms_to_stated(spark, [bad])


def test_extracts_are_written(spark, names, tmp_path):
    more = {**BASE, "description": [*BASE["description"], ("2", 20200101, 1, M, 12, "en", 900000000000013009, "not this", 0)]}
    parts = services.extract(spark, [write(tmp_path / "base", more)], spark.createDataFrame([(13,)], "id long"))
    sinks.write_extract(parts, f"file://{tmp_path}/out")
    lines = {k: [r.value for r in spark.read.text(f"file://{tmp_path}/out/{k}/rows").collect()] for k in parts}
    assert lines == {"concept": [f"13\t20200101\t1\t{M}\t{DEFINED_}"], "description": ['1\t20200101\t1\t900000000000207008\t13\ten\t900000000000003001\tA "quoted" disorder\t0'], "language": [], "axiom": []}


def test_only_line_feeds_end_a_line_and_files_are_read_once(spark, names, tmp_path):
    term = "a b\u0085c\x0cd"
    base = write(tmp_path / "base", {**BASE, "description": [("1", 20200101, 1, M, 13, "en", 900000000000003001, term, 0)]})
    (tmp_path / "base" / "sct2_Other_X.txt").write_text("not a kind that is read\n")
    with zipfile.ZipFile(tmp_path / "base.zip", "w") as z:
        for path in (tmp_path / "base").iterdir():
            z.writestr(f"Snapshot/{path.name}", path.read_text().replace("\n", "\r\n"))
    for at in (base, str(tmp_path / "base.zip")):
        raw = releases.read_raw(spark, [at], "language")
        assert [r.term for r in raw["description"].collect()] == [term]
        assert raw["concept"].count() == len(CONCEPTS)
    files = releases.read_raw(spark, [base])["concept"].inputFiles()
    assert [f.rpartition("/")[2] for f in files] == [NAMES["concept"]]


def test_rows_to_axioms_choose_by_the_parent(spark):
    rows = spark.createDataFrame(
        [(1, 0, IS_A, 5, None, None), (2, 0, IS_A, 6, None, None), (2, 1, 7, 8, None, None), (3, 0, IS_A, 9, None, None)], "conceptId long, grp int, typeId long, destinationId long, kind string, text string"
    )
    attributes = spark.createDataFrame([(5, "SubObjectPropertyOf"), (9, "SubDataPropertyOf")], "id long, kind string")
    defined = spark.createDataFrame([(2,)], "conceptId long")
    found = {r.conceptId: r.axiom for r in axioms.concept_axioms(rows, defined, attributes).collect()}
    assert found == {1: "SubObjectPropertyOf(:1 :5)", 2: f"EquivalentClasses(:2 ObjectIntersectionOf(:6 {group(some(7, 8))}))", 3: "SubDataPropertyOf(:3 :9)"}
    with pytest.raises(ValueError, match="concept 4"):
        axioms.concept_axioms(rows.unionByName(rows.limit(1).selectExpr("4L as conceptId", "1 as grp", "7L as typeId", "8L as destinationId", "kind", "text")), defined, attributes)
    for both in ((8, "INTEGER", "1"), (None, None, None)):
        wrong = spark.createDataFrame([(1, 0, 7, *both)], rows.schema)
        with pytest.raises(Exception, match="either a destination or a value"):
            axioms.class_expressions(wrong).collect()


def test_what_nothing_can_be(spark):
    texts = ["SubClassOf(:1 ObjectIntersectionOf(:2 :3))", "SubClassOf(ObjectIntersectionOf(:2 :3) owl:Nothing)", "SubClassOf(:4 ObjectSomeValuesFrom(:9 :1))", "SubClassOf(:5 :2)"]
    rules = axioms.normalised(spark.createDataFrame([(t,) for t in texts], "axiom string"))
    subsumed = classify.saturate(rules)
    assert {r.concept for r in classify.unsatisfiable(subsumed).collect()} == {1, 4}
    parents, _, _ = classify.taxonomy(subsumed, None)
    assert {(r.child, r.parent) for r in parents.collect()} == {(5, 2)}


def test_concepts_with_one_definition_cost_what_one_does(spark):
    many = range(1, 31)
    texts = [f"EquivalentClasses(:{i} ObjectIntersectionOf(:100 ObjectSomeValuesFrom(:9 :101)))" for i in many]
    texts += ["EquivalentClasses(:1 ObjectIntersectionOf(:102 :103))", "SubClassOf(:50 :102)", "SubClassOf(:50 :103)", "EquivalentClasses(:60 owl:Nothing)", "SubClassOf(:61 :60)"]
    rules = axioms.normalised(spark.createDataFrame([(t,) for t in texts], "axiom string"))
    found, same = classify.saturated(rules)
    assert found.count() < 20
    every = classify.saturate(rules)
    pairs = {(r.child, r.ancestor) for r in every.filter("ancestor > 0 and child < 60").collect()}
    assert pairs == {(i, j) for i in many for j in (*many, 100, 102, 103) if i != j} | {(50, j) for j in (*many, 100, 102, 103)}
    assert {r.concept for r in classify.unsatisfiable(every).collect()} == {60, 61}
    parents, sets, _ = classify.taxonomy(found, None, same)
    assert {(r.set_id, r.member) for r in sets.collect()} == {(1, i) for i in many}
    assert {(r.child, r.parent) for r in parents.collect()} == {(i, 1) for i in many if i > 1} | {(1, 100), (1, 102), (1, 103), (50, 1)}
