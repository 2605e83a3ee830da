"""Rules of the catalog domain, as data."""

# fixed values: attributes of each category as (identity-critical, variant-critical, non-critical)
CATEGORY_SCHEMAS = {
    "PIPE": (["material"], ["nominal_size_mm", "schedule", "grade"], ["standard"]),
    "VALVE": (["valve_type", "body_material"], ["nominal_size_mm", "pressure_class"], ["standard"]),
    "FLANGE": (["flange_type", "material"], ["nominal_size_mm", "pressure_class"], ["standard"]),
    "GASKET": (["gasket_type", "material"], ["nominal_size_mm", "pressure_class"], ["standard"]),
    "BEARING": (["bearing_type", "bearing_number"], ["bore_mm", "seal_type"], ["manufacturer"]),
    "MOTOR": (["voltage_v", "phase"], ["power_kw", "rpm"], ["enclosure", "manufacturer"]),
    "CABLE": (["conductor"], ["cores", "csa_sqmm", "voltage_grade_kv"], ["standard", "armour"]),
    "PUMP": (["pump_type"], ["power_hp", "phase"], ["manufacturer"]),
    "FASTENER": (["fastener_type"], ["size", "grade"], ["coating", "standard"]),
    "FILTER": (["filter_type"], ["micron_rating", "connection_size_mm"], ["manufacturer"]),
}
OPEN_SCHEMA = (["material"], ["nominal_size_mm", "standard"], [])

# fixed values: schema key -> rule that fills it, in comparison order
CATEGORY_FIELDS = {
    "PIPE": {"material": "material_type", "nominal_size_mm": "size_mm", "grade": "grade", "standard": "standard", "schedule": "schedule"},
    "VALVE": {"valve_type": "valve_type", "body_material": "material_type", "nominal_size_mm": "size_mm", "pressure_class": "pressure_class", "standard": "standard"},
    "FLANGE": {"flange_type": "flange_type", "material": "material_type", "nominal_size_mm": "size_mm", "pressure_class": "pressure_class", "standard": "standard"},
    "GASKET": {"gasket_type": "gasket_type", "material": "material_type", "nominal_size_mm": "size_mm", "pressure_class": "pressure_class", "standard": "standard"},
    "BEARING": {"bearing_type": "bearing_type", "bearing_number": "bearing_number", "bore_mm": "size_mm", "seal_type": "seal_type"},
    "MOTOR": {"power_kw": "power_kw", "voltage_v": "voltage_v", "phase": "phase", "rpm": "rpm"},
    "CABLE": {"conductor": "material_type", "cores": "cores", "csa_sqmm": "csa_sqmm", "voltage_grade_kv": "voltage_grade_kv", "standard": "standard"},
    "PUMP": {"pump_type": "pump_type", "power_hp": "power_hp", "phase": "phase"},
    "FASTENER": {"fastener_type": "fastener_type", "size": "bolt_size", "grade": "grade"},
    "FILTER": {"filter_type": "filter_type", "micron_rating": "micron_rating", "connection_size_mm": "size_mm"},
}
OPEN_FIELDS = {"material": "material_type", "grade": "grade", "nominal_size_mm": "size_mm", "standard": "standard", "model": "model"}
NUMERIC_RULES = {"size_mm", "power_kw", "power_hp", "voltage_v", "rpm", "cores", "csa_sqmm", "voltage_grade_kv", "micron_rating"}

# fixed values: (pattern, code), first hit wins, case ignored
MATERIAL_RULES = [
    (r"\b(?:S\.?S\.?304|SS304|Stainless\s?Steel\s?304)\b", "SS304"),
    (r"\b(?:S\.?S\.?316|SS316|Stainless\s?Steel\s?316)\b", "SS316"),
    (r"\b(?:S\.?S\.?|Stainless\s?Steel)\b", "SS"),
    (r"\b(?:C\.?S\.?|Carbon\s?Steel)\b", "CS"),
    (r"\b(?:M\.?S\.?|Mild\s?Steel)\b", "MS"),
    (r"\b(?:C\.?I\.?|Cast\s?Iron)\b", "CI"),
    (r"\b(?:G\.?I\.?|Galvani[sz]ed\s?Iron)\b", "GI"),
    (r"\bPVC\b", "PVC"),
    (r"\bHDPE\b", "HDPE"),
    (r"\bBrass\b", "BRASS"),
    (r"\bBronze\b", "BRONZE"),
    (r"\bCopper\b", "COPPER"),
    (r"\bAluminium\b", "ALUMINIUM"),
    (r"\bAluminum\b", "ALUMINIUM"),
    (r"\b(?:CAF|Compressed\s?Asbestos\s?Fibre)\b", "CAF"),
    (r"\bPTFE\b", "PTFE"),
    (r"\bGraphite\b", "GRAPHITE"),
]
# fixed values: (pattern, prefix of the captured value)
GRADE_RULES = [
    (r"\bGrade\s+([A-Z0-9.]+)\b", ""),
    (r"\bGr(?!ade)\.?\s?([A-Z0-9.]+)\b", ""),
    (r"\bType\s?(\d{3})\b", "TP"),
    (r"\bTP\.?\s?(\d+)\b", "TP"),
    (r"\b(Class\s?\d+)\b", ""),
]
# fixed values
STANDARD_RULES = [
    r"\b(?:ASTM|ASME|IS|DIN|ISO|BS|SAE|AISI|IEC|API)\s*[\w\d.-]+",
    r"\bIS\s?\d+\b",
    r"\bASTM\s?[A-Z]?\d+\b",
    r"\bDIN\s?\d+\b",
    r"\bAPI\s?\d+\b",
    r"\bASME\s?B?\d+(?:\.\d+)?\b",
    r"\bISO\s?\d+\b",
    r"\bIEC\s?\d+\b",
]
# fixed values: nominal inches -> millimetres
NOMINAL_INCH = {0.5: 15, 1: 25, 1.5: 40, 2: 50, 2.5: 65, 3: 80, 4: 100, 6: 150, 8: 200}
# fixed values: what stands for a size, in order; the number is in millimetres times the unit's factor (the second group), if there is one
INCH_RULE = r"(?i)(\d+(?:\.\d+)?)\s?(?:inch|\")"
SIZE_RULES = [
    r"(?i)\bDN\s?(\d+(?:\.\d+)?)\b()",
    r"(?i)(\d+(?:\.\d+)?)\s?mm\b()",
    r"(?i)\b(?:NB|OD|ID)\s*(\d+(?:\.\d+)?)\s*(MM|CM|M|INCH|IN)?\b",
    r"(?i)\b(\d+(?:\.\d+)?)\s*(CM|M|IN)\b",
]
UNIT_MM = {"CM": 10.0, "M": 1000.0, "IN": 25.4, "INCH": 25.4}
# fixed values: patterns of one group, and what is put before it; the first that is found counts
PREFIXED_RULES = {
    "bolt_size": [(r"\bM\s?(\d{1,2})\b", "M")],
    "bearing_number": [(r"\b(6\d{3})\b", "")],
    "pressure_class": [(r"(?i)\bCLASS\s?(\d+)\b", "CLASS"), (r"(?i)\bPN\s?(\d+)\b", "PN"), (r"\b(\d+)\s?#", "CLASS")],
    "schedule": [(r"(?i)\bSCH\s?(\d+)\b", "SCH")],
}
# fixed values: patterns and the code that the first to be found stands for
CODED_RULES = {
    "phase": [(r"(?i)\b3\s?[-]?\s?ph(?:ase)?\b", "3PH"), (r"(?i)\b1\s?[-]?\s?ph(?:ase)?\b", "1PH")],
    "seal_type": [(r"(?i)\b2RS\b", "2RS"), (r"\bZZ\b", "ZZ"), (r"(?i)\bOPEN\b", "OPEN")],
}
# fixed value: a maker's model number
MODEL_RULE = r"(?i)\b[A-Z0-9]{3,}(?:-[A-Z0-9]+)+\b"
# fixed values: number before a unit
NUMBER_RULES = {
    "power_kw": r"(?i)(\d+(?:\.\d+)?)\s?KW",
    "power_hp": r"(?i)(\d+(?:\.\d+)?)\s?H\.?P\.?",
    "voltage_v": r"(?i)(\d+(?:\.\d+)?)\s?V\b",
    "rpm": r"(?i)(\d+(?:\.\d+)?)\s?RPM",
    "cores": r"(?i)(\d+)\s?C(?:ore)?",
    "csa_sqmm": r"(?i)(\d+(?:\.\d+)?)\s?sq\.?\s?mm",
    "voltage_grade_kv": r"(?i)(\d+(?:\.\d+)?)\s?KV",
    "micron_rating": r"(?i)(\d+)\s?MIC(?:RON)?",
}
# fixed values: (code, keywords), first hit wins
TYPE_RULES = {
    "valve_type": [("GATE", ["GATE"]), ("GLOBE", ["GLOBE"]), ("BALL", ["BALL"]), ("BUTTERFLY", ["BUTTERFLY"]), ("CHECK", ["CHECK"])],
    "flange_type": [
        ("WELDNECK", ["WELD NECK", "WELDNECK", "WELD-NECK"]),
        ("SLIPON", ["SLIP-ON", "SLIP ON", "SLIPON"]),
        ("BLIND", ["BLIND"]),
        ("SOCKETWELD", ["SOCKET WELD", "SOCKETWELD", "SOCKET-WELD"]),
    ],
    "gasket_type": [("SPIRALWOUND", ["SPIRAL WOUND", "SPIRALWOUND"]), ("RING JOINT", ["RING JOINT"]), ("FULL FACE", ["FULL FACE"])],
    "bearing_type": [("TAPERED ROLLER", ["TAPERED ROLLER"]), ("DEEP GROOVE BALL", ["DEEP GROOVE"]), ("ROLLER", ["ROLLER"])],
    "pump_type": [("CENTRIFUGAL", ["CENTRIFUGAL"]), ("SUBMERSIBLE", ["SUBMERSIBLE"]), ("RECIPROCATING", ["RECIPROCATING"])],
    "fastener_type": [
        ("HEX BOLT", ["HEXAGONAL HEAD BOLT", "HEX BOLT", "HEXAGONAL BOLT"]),
        ("HEX NUT", ["HEXAGONAL NUT", "HEX NUT"]),
        ("STUD", ["STUD BOLT", "STUD"]),
        ("WASHER", ["FLAT WASHER", "WASHER"]),
    ],
    "filter_type": [("OIL FILTER", ["OIL FILTER"]), ("AIR FILTER", ["AIR FILTER"]), ("FUEL FILTER", ["FUEL FILTER"]), ("STRAINER", ["Y-TYPE STRAINER", "STRAINER"])],
}
# fixed values: display names -> category
CATEGORY_ALIASES = {
    "PIPE": ["pipes & tubes", "pipes and tubes", "pipes", "tube", "tubes"],
    "VALVE": ["industrial valves", "industrial valve", "valves"],
    "FLANGE": ["pipe flanges", "pipe flange", "flanges"],
    "PUMP": ["industrial pumps", "industrial pump", "pumps"],
    "BEARING": ["bearings"],
    "FASTENER": ["fasteners & studs", "fasteners and studs", "fasteners", "studs"],
    "MOTOR": ["electric motors", "electric motor", "motors"],
    "CABLE": ["electrical cable", "electrical cables", "cables"],
}
# fixed values: keyword rules in order
KEYWORD_RULES = [
    ("BEARING", ["BEARING", "BUSHING"]), ("VALVE", ["VALVE"]), ("FLANGE", ["FLANGE"]), ("PUMP", ["PUMP"]), ("MOTOR", ["MOTOR"]), ("CABLE", ["CABLE"]),
    ("FASTENER", ["BOLT", "NUT", "FASTENER", "WASHER", "STUD"]), ("PIPE", ["PIPE", "TUBE", "TUBING"]),
]
# fixed values: (segment, family, class); GASKET and FILTER have codes of our own, so that codes stay unique
COMMODITY_CODES = {
    "PIPE": ("40", "14", "07"), "VALVE": ("40", "14", "16"), "FLANGE": ("40", "14", "17"), "PUMP": ("40", "15", "15"), "BEARING": ("31", "17", "15"),
    "FASTENER": ("31", "16", "15"), "MOTOR": ("26", "10", "11"), "CABLE": ("26", "12", "16"), "GASKET": ("31", "18", "01"), "FILTER": ("40", "16", "15"),
    "GENERAL_MRO": ("99", "99", "99"),
}
# fixed values: upload header aliases in order
HEADER_ALIASES = {
    "enterprise": ["cpse_name", "cpse", "enterprise", "plant", "company", "org", "werks"],
    "local_code": ["cpse_material_code", "material_code", "mat_no", "item_code", "matnr", "code", "part_no", "part_num", "sap_code"],
    "description": ["description", "desc", "short_text", "material_description", "item_desc", "material_name", "name", "maktx"],
    "specification": ["specification", "spec", "standard", "grade", "astm", "spec_grade", "material_grade"],
    "uom": ["unit_of_measure", "uom", "unit", "base_uom", "meins", "units"],
    "category": ["category", "material_group", "group", "commodity", "class", "matkl", "type"],
    "price": ["nominal_price", "price", "unit_price", "rate", "cost", "amount", "po_rate", "netpr"],
}
# fixed values: relationship labels, and those that mean the same item
LABELS = ["EXACT_DUPLICATE", "FUNCTIONALLY_EQUIVALENT", "NEAR_DUPLICATE", "NEEDS_REVIEW", "NOT_A_MATCH", "VARIANT"]
SAME_ITEM = ["EXACT_DUPLICATE", "NEAR_DUPLICATE"]
HIGH, MEDIUM, LEAST_MATCH, MARGIN = 0.85, 0.60, 0.30, 0.10
MODEL_VERSION = "forest-1"
AUDIT_ENTITIES = ["MATERIAL", "MAPPING", "GROUP", "USER", "JOB", "CATEGORY", "POLICY", "EXPORT"]
GENESIS = "0" * 64
