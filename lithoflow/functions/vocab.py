"""Vocabularies and constants of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The index vocabulary by category.
INDEX_TERMS = {
    "well_logs": ["gamma ray", "GR", "resistivity", "RT", "RD", "RS", "spontaneous potential", "SP", "neutron", "NPHI", "density", "RHOB", "photoelectric", "PEF", "sonic", "DT", "caliper", "CAL", "deep resistivity", "shallow resistivity"],
    "sequence_stratigraphy": ["sequence boundary", "SB", "maximum flooding surface", "MFS", "transgressive surface", "TS", "lowstand systems tract", "LST", "transgressive systems tract", "TST", "highstand systems tract", "HST", "systems tract", "parasequence", "stacking pattern", "accommodation space", "base level", "relative sea level", "sequence stratigraphic"],
    "depositional_environments": ["marine", "fluvial", "delta", "deltaic", "channel", "shoreface", "beach", "tidal", "barrier", "shelf", "basin", "turbidite", "submarine fan", "aeolian", "lagoonal"],
    "lithology": ["sandstone", "sand", "shale", "mudstone", "limestone", "dolomite", "conglomerate", "coal", "anhydrite", "evaporite", "calcareous", "siliceous", "arkose"],
    "patterns": ["funnel pattern", "bell pattern", "boxcar pattern", "bow pattern", "cleaning up", "dirtying up", "coarsening upward", "fining upward", "progradational", "retrogradational"],
}

# The extraction vocabulary by category.
EXTRACTION_TERMS = {
    "log_curves": ["gamma ray", "GR", "resistivity", "RT", "RD", "RS", "spontaneous potential", "SP", "neutron", "NPHI", "density", "RHOB", "photoelectric", "PEF", "sonic", "DT", "caliper", "CAL", "deep resistivity", "shallow resistivity", "laterolog", "microresistivity", "MSFL", "formation micro imager", "FMI", "borehole imaging"],
    "patterns": ["funnel pattern", "bell pattern", "boxcar pattern", "cylindrical pattern", "bow pattern", "serrated pattern", "cleaning up", "dirtying up", "coarsening upward", "fining upward", "aggradational", "progradational", "retrogradational", "stacking pattern", "log signature", "log response", "log character"],
    "sequence_stratigraphy": ["sequence boundary", "SB", "maximum flooding surface", "MFS", "transgressive surface", "TS", "ravinement surface", "RS", "lowstand systems tract", "LST", "transgressive systems tract", "TST", "highstand systems tract", "HST", "falling stage systems tract", "FSST", "depositional sequence", "parasequence", "systems tract", "relative sea level", "accommodation space", "base level", "sequence stratigraphic", "SPEM"],
    "depositional_environments": ["shoreface", "foreshore", "backshore", "delta", "deltaic", "delta front", "delta plain", "fluvial", "channel", "point bar", "levee", "floodplain", "crevasse splay", "tidal", "estuarine", "lagoonal", "barrier", "beach", "aeolian", "dune", "marine", "offshore", "shelf", "slope", "basin", "turbidite", "submarine fan"],
    "lithology": ["sandstone", "sand", "shale", "mudstone", "siltstone", "limestone", "dolomite", "conglomerate", "breccia", "coal", "evaporite", "anhydrite", "salt", "clean sand", "dirty sand", "shaly sand", "calcareous", "siliceous", "arkose", "quartz arenite", "sublitharenite", "litharenite"],
    "structural_geological": ["fault", "fracture", "fold", "anticline", "syncline", "unconformity", "angular unconformity", "disconformity", "nonconformity", "paraconformity", "structural dip", "bedding", "lamination", "cross-bedding", "bioturbation"],
    "reservoir_terms": ["reservoir", "porosity", "permeability", "net pay", "gross pay", "water saturation", "hydrocarbon saturation", "seal", "cap rock", "source rock", "migration", "trap", "structural trap", "stratigraphic trap", "combination trap"],
}

# Curve types and what their mnemonics contain, in order.
CURVE_TYPES = {
    "GR": ["GR", "GAMMA", "GAPI", "GRC", "GRDE"],
    "SP": ["SP", "SPONTPOT", "SPT"],
    "RES": ["RES", "RILD", "RILM", "RLA1", "RLA2", "RLA3", "RT"],
    "NPHI": ["NPHI", "NEU", "NEUTRON", "NPOR"],
    "RHOB": ["RHOB", "DEN", "DENSITY", "DENB"],
    "DT": ["DT", "SONIC", "AC", "TRANSIT"],
    "CALIPER": ["CAL", "CALIPER", "CALI"],
}

# Section headers, as patterns; keyword lists of chunk types; keyword list of the knowledge base.
SECTION_PATTERNS = ["Well logs? and sequence stratigraphic interpretation", "Well Log Interpretation", "Log Response Patterns?", "Depositional Environment", "Sequence Stratigraphy", "Systems Tract", "Maximum Flooding Surface", "Transgressive Surface", "Sequence Boundary", "Gamma Ray Response", "Resistivity", "Spontaneous Potential", "Neutron", "Density", "Sonic", "Funnel.{0,20}Pattern", "Bell.{0,20}Pattern", "Boxcar.{0,20}Pattern", "La Pascua Formation", "Venezuela", "Guarico"]
PATTERN_KEYWORDS = ["funnel", "bell", "boxcar", "cylindrical", "pattern", "trend", "coarsening", "fining", "upward", "cleaning", "dirtying"]
SURFACE_KEYWORDS = ["maximum flooding", "transgressive surface", "sequence boundary", "mfs", "ts", "sb", "unconformity", "flooding", "boundary"]
ENVIRONMENT_KEYWORDS = ["shoreface", "delta", "channel", "tidal", "barrier", "beach", "marine", "fluvial", "depositional", "environment", "facies"]
KNOWLEDGE_TERMS = ["gamma ray", "resistivity", "spontaneous potential", "neutron", "density", "funnel", "bell", "boxcar", "pattern", "trend", "maximum flooding surface", "transgressive surface", "sequence boundary", "lowstand", "transgressive", "highstand", "systems tract", "shoreface", "delta", "channel", "tidal", "barrier", "beach", "coarsening", "fining", "upward", "prograding", "retrograding", "sand", "shale", "limestone", "reservoir", "seal"]

# Canned query texts by pattern and by surface.
PATTERN_QUERIES = {
    "funnel": "funnel pattern cleaning up trend coarsening upward prograding shoreline",
    "bell": "bell pattern dirtying up trend fining upward transgressive deepening",
    "boxcar": "boxcar cylindrical pattern channel sand turbidite fluvial",
    "bow": "bow pattern symmetrical barrel progradation retrogradation",
    "irregular": "irregular pattern aggradation shale silt",
}
SURFACE_QUERIES = {
    "mfs": "maximum flooding surface radioactive shale marine condensed",
    "ts": "transgressive surface sea level rise marine flooding",
    "sb": "sequence boundary unconformity erosion incised valley lowstand",
    "rs": "ravinement surface wave erosion transgressive lag",
}

# Interpretation lists.
ENVIRONMENTS = ["shoreface", "delta", "fluvial", "channel", "marine", "tidal", "barrier", "beach", "lagoon", "shelf", "slope", "turbidite"]
EVIDENCE_STARTS = ["evidence", "supported by", "indicated by", "shown by"]
RECOMMENDATION_STARTS = ["recommend", "suggest", "should", "consider"]
PATTERN_TERMS = {"funnel": "prograding lowstand forced regression", "bell": "transgressive retrogradation flooding", "boxcar": "aggradation highstand channel"}
ENVIRONMENT_TERMS = {"funnel": "shoreface deltaic progradational", "bell": "transgressive marine flooding", "boxcar": "channel fluvial turbidite"}
PATTERN_TRACTS = {"funnel": "LST/Forced Regression", "bell": "TST", "boxcar": "HST/LST Channel"}

# Query engine and facade lists.
QUERY_COMMON_WORDS = ["and", "at", "by", "for", "from", "in", "of", "on", "the", "to", "with"]
ANSWER_COMMON_WORDS = ["also", "been", "could", "from", "have", "should", "such", "that", "their", "then", "there", "these", "they", "this", "those", "were", "what", "when", "where", "which", "with", "would"]
PAGE_PATTERNS = [r"Page (\d+)", r"page (\d+)", r"\| Page (\d+) \|", r"Page: (\d+)"]
CAPTION_PATTERNS = [r"Figure\s+\d+[:\.\-\s]+([^\.]+)", r"Fig\.\s+\d+[:\.\-\s]+([^\.]+)", r"Table\s+\d+[:\.\-\s]+([^\.]+)", r"Plate\s+\d+[:\.\-\s]+([^\.]+)"]
INDICATOR_WORDS = ["log", "curve", "response", "well", "formation", "geology", "stratigraphy", "sequence", "content"]
CONTENT_DESCRIPTIONS = {
    "well_log": "well logging data (gamma ray curves, resistivity logs, SP logs)",
    "figure": "geological diagrams, maps, or cross-sections",
    "core_photo": "photographs of rock core samples",
    "seismic": "seismic survey data and interpretations",
    "stratigraphic": "stratigraphic columns and sequence charts",
    "other": "miscellaneous geological content",
    "unknown": "unclassified geological content",
}


def flat(vocabulary: dict[str, list[str]]) -> list[str]:
    """The terms of all categories, each once, in order."""
    return list(dict.fromkeys(t for terms in vocabulary.values() for t in terms))


def as_table(spark: SparkSession, name: str, vocabulary: dict[str, list[str]]) -> DataFrame:
    """``vocab, category, ord, term``."""
    rows = [(name, c, i, t) for c, terms in vocabulary.items() for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "vocab string, category string, ord int, term string")
