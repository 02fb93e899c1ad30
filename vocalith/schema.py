"""Column types of release files, and the fixed identifiers that give rows their meaning."""

from __future__ import annotations

from pyspark.sql import types as T

# Identifiers of the release format.
ROOT = 138875005
IS_A = 116680003
CORE_MODULE = 900000000000207008
MODEL_MODULE = 900000000000012004
MODEL_COMPONENT = 900000000000441003
DEFINED = 900000000000073002
PRIMITIVE = 900000000000074008
EXISTENTIAL = 900000000000451002
UNIVERSAL = 900000000000452009
INFERRED = 900000000000011006
STATED = 900000000000010007
ADDITIONAL = 900000000000227009
FSN = 900000000000003001
SYNONYM = 900000000000013009
TEXT_DEFINITION = 900000000000550004
PREFERRED = 900000000000548007
ACCEPTABLE = 900000000000549004
ALL_CONTENT = 723594008
ONTOLOGY_REFSET = 762103008
AXIOM_REFSET = 733073007
MRCM_DOMAIN_REFSET = 723561005
NAMESPACE_ROW = 734146004
HEADER_ROW = 734147008
MODEL_ATTRIBUTE = 410662002
OBJECT_ATTRIBUTE = 762705008
DATA_ATTRIBUTE = 762706009
ANNOTATION_ATTRIBUTE = 1295447006
ROLE_GROUP = 609096000
LEGACY_ROLE_GROUP = "roleGroup"
DEFAULT_UNGROUPED = (123005000, 272741003, 127489000, 411116001)
INTERNATIONAL_MODULES = (CORE_MODULE, MODEL_MODULE)

_HEAD = [("id", T.LongType()), ("effectiveTime", T.IntegerType()), ("active", T.BooleanType()), ("moduleId", T.LongType())]
_MEMBER = [("id", T.StringType()), *_HEAD[1:], ("refsetId", T.LongType()), ("referencedComponentId", T.LongType())]
_EDGE = [
    *_HEAD, ("sourceId", T.LongType()), ("destinationId", T.LongType()), ("relationshipGroup", T.IntegerType()),
    ("typeId", T.LongType()), ("characteristicTypeId", T.LongType()), ("modifierId", T.LongType()),
]

#: Kind of file: pattern of its name, columns in order.
FILES: dict[str, tuple[str, list[tuple[str, T.DataType]]]] = {
    "concept": (r"sct2_Concept_", [*_HEAD, ("definitionStatusId", T.LongType())]),
    "relationship": (r"sct2_Relationship_", _EDGE),
    "stated": (r"sct2_StatedRelationship_", _EDGE),
    "concrete": (r"sct2_RelationshipConcreteValues_", [(n if n != "destinationId" else "value", t if n != "destinationId" else T.StringType()) for n, t in _EDGE]),
    "description": (
        r"sct2_(Description|TextDefinition)_",
        [*_HEAD, ("conceptId", T.LongType()), ("languageCode", T.StringType()), ("typeId", T.LongType()), ("term", T.StringType()), ("caseSignificanceId", T.LongType())],
    ),
    "axiom": (r"sct2_sRefset_OWLAxiom", [*_MEMBER, ("owlExpression", T.StringType())]),
    "ontology": (r"sct2_sRefset_OWLOntology", [*_MEMBER, ("owlExpression", T.StringType())]),
    "language": (r"der2_cRefset_Language", [*_MEMBER, ("acceptabilityId", T.LongType())]),
    "mrcm": (
        r"der2_cissccRefset_MRCMAttributeDomain",
        [*_MEMBER, ("domainId", T.LongType()), ("grouped", T.StringType()), ("attributeCardinality", T.StringType()),
         ("attributeInGroupCardinality", T.StringType()), ("ruleStrengthId", T.LongType()), ("contentTypeId", T.LongType())],
    ),
}

#: The profiles of a load: which kinds of file are read.
PROFILES = {
    "base": ("concept", "relationship", "stated", "concrete", "axiom", "ontology", "mrcm"),
    "language": ("concept", "relationship", "stated", "concrete", "axiom", "ontology", "mrcm", "description", "language"),
    "owl": ("concept", "relationship", "concrete", "axiom", "ontology", "mrcm"),
}


def columns(kind: str) -> list[str]:
    return [n for n, _ in FILES[kind][1]]


def struct(kind: str) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in FILES[kind][1]])
