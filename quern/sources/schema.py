"""Schemas of STEP files: names of types, their attributes in order, kinds of aggregates and supertypes.

A whole schema is read from its EXPRESS text (a parameter: the text is
published with each schema). Without one, :data:`CORE` has the types that the
library's rules name; other types are named by rule and get arg0, arg1, ...
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Types of the published schema, "Type(Supertype): attributes in order"; {}, [] and <> mark sets, lists and bags.
CORE = """
IfcRoot: GlobalId OwnerHistory Name Description
IfcObjectDefinition(IfcRoot):
IfcObject(IfcObjectDefinition): ObjectType
IfcContext(IfcObjectDefinition): ObjectType LongName Phase RepresentationContexts{} UnitsInContext
IfcProject(IfcContext):
IfcProduct(IfcObject): ObjectPlacement Representation
IfcElement(IfcProduct): Tag
IfcBuildingElement(IfcElement):
IfcBeam(IfcBuildingElement): PredefinedType
IfcBuildingElementProxy(IfcBuildingElement): PredefinedType
IfcColumn(IfcBuildingElement): PredefinedType
IfcCovering(IfcBuildingElement): PredefinedType
IfcCurtainWall(IfcBuildingElement): PredefinedType
IfcDoor(IfcBuildingElement): OverallHeight OverallWidth PredefinedType OperationType UserDefinedOperationType
IfcMember(IfcBuildingElement): PredefinedType
IfcPlate(IfcBuildingElement): PredefinedType
IfcRailing(IfcBuildingElement): PredefinedType
IfcRoof(IfcBuildingElement): PredefinedType
IfcSlab(IfcBuildingElement): PredefinedType
IfcStair(IfcBuildingElement): PredefinedType
IfcWall(IfcBuildingElement): PredefinedType
IfcWallStandardCase(IfcWall):
IfcWindow(IfcBuildingElement): OverallHeight OverallWidth PredefinedType PartitioningType UserDefinedPartitioningType
IfcFurnishingElement(IfcElement):
IfcFurniture(IfcFurnishingElement): PredefinedType
IfcFeatureElement(IfcElement):
IfcFeatureElementSubtraction(IfcFeatureElement):
IfcOpeningElement(IfcFeatureElementSubtraction): PredefinedType
IfcSpatialElement(IfcProduct): LongName
IfcSpatialStructureElement(IfcSpatialElement): CompositionType
IfcSite(IfcSpatialStructureElement): RefLatitude[] RefLongitude[] RefElevation LandTitleNumber SiteAddress
IfcBuilding(IfcSpatialStructureElement): ElevationOfRefHeight ElevationOfTerrain BuildingAddress
IfcBuildingStorey(IfcSpatialStructureElement): Elevation
IfcSpace(IfcSpatialStructureElement): PredefinedType ElevationWithFlooring
IfcGroup(IfcObject):
IfcRelationship(IfcRoot):
IfcRelAggregates(IfcRelationship): RelatingObject RelatedObjects{}
IfcRelNests(IfcRelationship): RelatingObject RelatedObjects[]
IfcRelContainedInSpatialStructure(IfcRelationship): RelatedElements{} RelatingStructure
IfcRelDefinesByProperties(IfcRelationship): RelatedObjects{} RelatingPropertyDefinition
IfcRelDefinesByType(IfcRelationship): RelatedObjects{} RelatingType
IfcRelAssociatesMaterial(IfcRelationship): RelatedObjects{} RelatingMaterial
IfcRelAssignsToGroup(IfcRelationship): RelatedObjects{} RelatedObjectsType RelatingGroup
IfcRelVoidsElement(IfcRelationship): RelatingBuildingElement RelatedOpeningElement
IfcRelFillsElement(IfcRelationship): RelatingOpeningElement RelatedBuildingElement
IfcRelConnectsElements(IfcRelationship): ConnectionGeometry RelatingElement RelatedElement
IfcRelConnectsPathElements(IfcRelConnectsElements): RelatingPriorities[] RelatedPriorities[] RelatedConnectionType RelatingConnectionType
IfcPropertySet(IfcRoot): HasProperties{}
IfcPropertySingleValue: Name Description NominalValue Unit
IfcMaterial: Name Description Category
IfcOwnerHistory: OwningUser OwningApplication State ChangeAction LastModifiedDate LastModifyingUser LastModifyingApplication CreationDate
IfcLocalPlacement: PlacementRelTo RelativePlacement
IfcAxis2Placement3D: Location Axis RefDirection
IfcAxis2Placement2D: Location RefDirection
IfcCartesianPoint: Coordinates[]
IfcDirection: DirectionRatios[]
IfcPolyline: Points[]
IfcProductDefinitionShape: Name Description Representations[]
IfcShapeRepresentation: ContextOfItems RepresentationIdentifier RepresentationType Items{}
IfcExtrudedAreaSolid: SweptArea Position ExtrudedDirection Depth
IfcMappedItem: MappingSource MappingTarget
IfcRepresentationMap: MappingOrigin MappedRepresentation
IfcUnitAssignment: Units{}
IfcSIUnit: Dimensions UnitType Prefix Name
IfcConversionBasedUnit: Dimensions UnitType Name ConversionFactor
IfcConversionBasedUnitWithOffset(IfcConversionBasedUnit): ConversionOffset
IfcDerivedUnit: Elements{} UnitType UserDefinedType
IfcDerivedUnitElement: Unit Exponent
IfcMeasureWithUnit: ValueComponent UnitComponent
"""

#: Names of measures that are not one capitalised word.
_MEASURES = "IfcNonNegativeLengthMeasure IfcPlaneAngleMeasure IfcPositiveLengthMeasure IfcPositivePlaneAngleMeasure IfcPositiveRatioMeasure IfcNormalisedRatioMeasure IfcSolidAngleMeasure IfcThermodynamicTemperatureMeasure IfcElectricCurrentMeasure IfcLuminousIntensityMeasure IfcAmountOfSubstanceMeasure IfcContextDependentMeasure"

_KINDS = {"{}": "set", "[]": "list", "<>": "bag"}
_GUID = re.compile(r"[0-3][0-9A-Za-z_$]{21}\Z")
_ROOT = ("GlobalId", "OwnerHistory", "Name", "Description")


@dataclass
class Schema:
    """Types by upper-case name: their name, own attributes with the kind of aggregate, and supertype."""

    types: dict[str, tuple[str, list[tuple[str, str | None]], str | None]] = field(default_factory=dict)
    #: Names of other types (measures, labels) by upper-case name.
    named: dict[str, str] = field(default_factory=dict)

    def name(self, keyword: str) -> str:
        """The type's name; one that the schema lacks is Ifc and the rest capitalised."""
        key = keyword.upper()
        found = self.types[key][0] if key in self.types else self.named.get(key)
        if found:
            return found
        if key.startswith("IFC") and key.endswith("MEASURE") and len(key) > 10:
            return f"Ifc{key[3:-7].capitalize()}Measure"
        return f"Ifc{key[3:].capitalize()}" if key.startswith("IFC") else keyword

    def attributes(self, keyword: str, first: str | None = None) -> list[tuple[str, str | None]]:
        """Attributes in order, inherited ones first; of an unknown type those of a root, if its first value is an identifier."""
        key = keyword.upper()
        if key not in self.types:
            return [(n, None) for n in _ROOT] if first is not None and _GUID.match(first) else []
        out: list = []
        while key:
            _, own, above = self.types[key]
            out = own + out
            key = above.upper() if above else None
            if key and key not in self.types:
                break
        return out

    def closure(self) -> list[tuple[str, str]]:
        """Every type with itself and each of its supertypes."""
        out = []
        for name, _, _ in self.types.values():
            key: str | None = name.upper()
            while key in self.types:
                out.append((name, self.types[key][0]))
                above = self.types[key][2]
                key = above.upper() if above else None
        return out


def core_schema() -> Schema:
    schema = Schema(named={m.upper(): m for m in _MEASURES.split()})
    for line in CORE.strip().split("\n"):
        head, _, rest = line.partition(":")
        name, _, above = head.partition("(")
        own = [(a[:-2], _KINDS[a[-2:]]) if a[-2:] in _KINDS else (a, None) for a in rest.split()]
        schema.types[name.upper()] = name, own, above.rstrip(")") or None
    return schema


_ENTITY = re.compile(r"\bENTITY\s+(\w+)(.*?)END_ENTITY\s*;", re.S | re.I)
_SECTION = re.compile(r";\s*(?:DERIVE|INVERSE|UNIQUE|WHERE)\b", re.I)
_AGGREGATE = re.compile(r"\b(SET|LIST|BAG|ARRAY)\b", re.I)


def express_schema(text: str) -> Schema:
    """The schema of an EXPRESS text: entities with their explicit attributes and first supertype, and names of other types."""
    text = re.sub(r"\(\*.*?\*\)|--[^\n]*", " ", text, flags=re.S)
    schema = Schema()
    for m in re.finditer(r"\bTYPE\s+(\w+)\s*=", text, re.I):
        schema.named[m[1].upper()] = m[1]
    for m in _ENTITY.finditer(text):
        name, body = m[1], m[2]
        above = re.search(r"SUBTYPE\s+OF\s*\(\s*(\w+)", body, re.I)
        own = []
        for declared in _SECTION.split(body, maxsplit=1)[0].split(";")[1:]:
            names, _, of = declared.partition(":")
            kind = _AGGREGATE.search(of)
            own += [(n.strip(), kind[1].lower() if kind else None) for n in names.split(",") if of]
        schema.types[name.upper()] = name, own, above[1] if above else None
    return schema
