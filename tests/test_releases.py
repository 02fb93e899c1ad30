"""A release of our own making, from files to delta."""

import zipfile

import pytest

from vocalith import __main__ as cli
from vocalith.plans import ontology, services
from vocalith.schema import DEFINED, EXISTENTIAL, FSN, INFERRED, IS_A, PRIMITIVE, ROOT, STATED, columns
from vocalith.sources import releases, sinks

M, SITE = 900000000000207008, 5010
NAMES = {"concept": "sct2_Concept_X.txt", "stated": "sct2_StatedRelationship_X.txt", "relationship": "sct2_Relationship_X.txt", "ontology": "sct2_sRefset_OWLOntology_X.txt",
         "axiom": "sct2_sRefset_OWLAxiom_X.txt", "description": "sct2_Description_X.txt"}


def edge(i, s, d, kind, type_=IS_A, group=0, active=1):
    return (i, 20200101, active, M, s, d, group, type_, kind, EXISTENTIAL)


#: A root with a body part (11), a finding (12), and a disorder (13) that is a finding at that site.
CONCEPTS = [(c, 20200101, 1, M, DEFINED if c == 13 else PRIMITIVE) for c in (ROOT, 11, 12, 13, SITE, 762705008, 410662002)]
EDGES = [(11, ROOT), (12, ROOT), (13, 12), (410662002, ROOT), (762705008, 410662002), (SITE, 762705008)]
BASE = {
    "concept": CONCEPTS,
    "stated": [edge(100 + i, *e, STATED) for i, e in enumerate(EDGES)] + [edge(190, 13, 11, STATED, SITE)],
    "relationship": [edge(200 + i, *e, INFERRED) for i, e in enumerate(EDGES)] + [edge(290, 13, 11, INFERRED, SITE), edge(295, 14, 11, INFERRED, SITE, 0, 0)],
    "ontology": [("a", 20200101, 1, M, 762103008, 734146004, "Prefix(:=<http://id.org/>)"), ("b", 20200101, 1, M, 762103008, 734147008, "Ontology(<http://o.org/x>)")],
    "axiom": [],
    "description": [("1", 20200101, 1, M, 13, "en", FSN, "A \"quoted\" disorder", 0)],
}
#: A new kind of the disorder.
DELTA = {"concept": [(14, "", 1, M, PRIMITIVE)], "stated": [edge(180, 14, 13, STATED)]}


def write(folder, rows):
    folder.mkdir()
    for kind, some in rows.items():
        lines = ["# a comment", "\t".join(columns(kind)), "", *["\t".join(map(str, r)) for r in some]]
        (folder / NAMES[kind]).write_text("\n".join(lines) + "\n")
    return str(folder)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    top = tmp_path_factory.mktemp("releases")
    return write(top / "base", BASE), write(top / "delta", DELTA)


def test_a_zip_reads_like_a_folder(spark, folders, tmp_path):
    path = tmp_path / "base.zip"
    with zipfile.ZipFile(path, "w") as z:
        for kind, name in NAMES.items():
            z.write(f"{folders[0]}/{name}", f"Snapshot/Terminology/{name}")
    for kind, rows in releases.read_raw(spark, [str(path)]).items():
        assert sorted(map(str, rows.collect())) == sorted(map(str, releases.read_raw(spark, [folders[0]])[kind].collect()))


def test_states_after_a_delta(spark, folders):
    release = releases.load(spark, [folders[0]], folders[1])
    assert {r.id for r in release.concepts.collect()} == {ROOT, 11, 12, 13, 14, SITE, 762705008, 410662002}
    assert release.inactive.isEmpty()
    assert {r.id for r in release.pool.collect()} == {295}
    assert releases.header(release) == "http://o.org/x"


def test_classification_adds_what_is_inherited_and_reuses_ids(spark, folders):
    result = services.classify(spark, [folders[0]], folders[1])
    found = {(r.action, r.id, r.sourceId, r.grp, r.typeId, r.destinationId) for r in result.delta.collect()}
    assert found == {("add", None, 14, 0, IS_A, 13), ("add", 295, 14, 0, SITE, 11)}
    assert result.equivalents.isEmpty()
    rows = sorted(r.row for r in sinks.relationship_rows(result.delta).collect())
    assert rows[0].split("\t") == ["", "", "1", "", "14", "13", "0", str(IS_A), str(INFERRED), str(EXISTENTIAL)]


def test_document(spark, folders):
    release = releases.load(spark, [folders[0]], profile="language")
    lines = [r.line for r in ontology.document(spark, release, version="20200101", labels=True).orderBy("place").collect()]
    assert lines[0] == "Prefix(:=<http://id.org/>)"
    assert "<http://o.org/x/version/20200101>" in lines
    assert "EquivalentClasses(:13 ObjectIntersectionOf(:12 ObjectSomeValuesFrom(:609096000 ObjectSomeValuesFrom(:5010 :11))))" in lines
    assert f"SubObjectPropertyOf(:{SITE} :762705008)" in lines
    assert 'AnnotationAssertion(rdfs:label :13 "A \\"quoted\\" disorder"@en)' in lines
    assert lines.index("Declaration(Class(:11))") < lines.index(f"Declaration(ObjectProperty(:{SITE}))") < lines.index("#   Classes")
    assert lines[-1] == ")"


def test_unknown_reasoners_and_arguments_fail_first(spark, tmp_path):
    with pytest.raises(KeyError):
        services.classify(spark, ["nowhere"], reasoner="none")
    for bad in (["classify"], ["classify", "--snapshot", "a,"], ["classify", "--snapshot", str(tmp_path / "missing")], ["rf2-stated-to-complete-owl-reconcile", "--snapshot", str(tmp_path)]):
        with pytest.raises(SystemExit):
            cli.parsed(bad)
