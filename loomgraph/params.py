"""Parameters of the operators, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass, field

# Source weights, aliases, relation types, classes, name lists and priors.
ENTITY_WEIGHTS = {
    "ageanno": 1.0, "agingatlas": 1.0, "ctd": 1.0, "daa": 1.0, "hagr": 1.0, "hall": 1.0, "hetionet": 1.0, "hgnc": 1.0, "icd10": 1.0, "mirbase": 1.0, "ncbi": 1.0, "opengenes": 1.0, "primekg": 1.0, "umls": 1.0, "uniport": 1.0,
    "jcrq1-if10-deepseekv3": 0.8, "agingrelated-deepseekv3": 0.8, "agingrelated-deepseekr1-32b": 0.7, "jcrq1-if10-deepseekr1-32b": 0.7, "agingrelated-deepseekr1-7b": 0.6, "jcrq1-if10-deepseekr1-7b": 0.6,
    "bert_model_prediction": 0.4, "en_ner_bc5cdr_md": 0.3, "en_ner_bionlp13cg_md": 0.3, "en_ner_jnlpba_md": 0.3,
}
RELATION_WEIGHTS = {
    "ageanno": 1.0, "agingatlas": 1.0, "ctd": 1.0, "hall": 1.0, "hetionet": 1.0, "opengenes": 1.0, "primekg": 1.0, "umls": 1.0,
    "jcrq1-if10-deepseekv3": 0.8, "agingrelated-deepseekv3": 0.8, "jcrq1-if10-deepseekr1-32b": 0.7, "agingrelated-deepseekr1-32b": 0.7, "jcrq1-if10-deepseekr1-7b": 0.6, "agingrelated-deepseekr1-7b": 0.6,
    "bert_model_prediction": 0.4,
}
SUBGRAPH_WEIGHTS = RELATION_WEIGHTS | {
    "jcrq1-if10-deepseekv3": 0.9, "agingrelated-deepseekv3": 0.9, "jcrq1-if10-deepseekr1-32b": 0.8, "agingrelated-deepseekr1-32b": 0.8, "jcrq1-if10-deepseekr1-7b": 0.7, "agingrelated-deepseekr1-7b": 0.7,
    "bert_model_prediction": 0.6,
}
RELATION_TYPES = {
    "Causal": [
        "causal", "causes", "causality", "causation", "causal relationships", "causal relationship", "causative", "cause", "association & causality", "association & causal", "association & causation",
        "influence", "influences", "influenced by", "influenced", "affects", "induces", "direct", "inverse", "outcome", "predictive", "mediation", "mediating", "etiological",
        "evidence supporting", "evidence-based", "protective", "treatment", "intervention", "involved in", "causative relationship", "cause-effect",
    ],
    "Association": [
        "association", "associative", "associational", "associated", "associated with", "assoc", "association relationships", "association relationship", "association & linkage", "association & link",
        "association & correlation", "association &", "connection", "no association", "negative association", "positive", "comparison", "compared", "correlation", "observational", "relevant", "evaluation",
        "trend", "process", "descriptive", "exploratory", "no relationship", "associative relationships", "relationship", "associative relationship", "positive association",
    ],
    "Regulatory": ["regulatory", "regulate", "regulatory relationships", "regulatory relationship", "regulates", "reg", "regulation"],
    "Structural/Belonging": [
        "structural/belonging", "structural/belonging relationships", "structural/belonging relationship", "part relationship", "structural", "structural relationship", "belonging", "belonging relationships",
        "belongs to", "part-whole", "part of", "part", "component of", "component", "subset", "whole", "instance", "classification", "part-of", "app feature", "belongs_to", "structural/biological",
    ],
    "Interaction & Feedback": [
        "interaction & feedback", "interaction & feedback relationships", "interaction", "feedback", "association & feedback", "association & interaction", "competitive", "connected", "interaction &feedback",
    ],
}
# Spellings of relation types in charts, in this very case; of a spelling in two lists the later counts.
CHART_RELATION_TYPES = {
    "Causal": [
        "Causal", "CAusal", "CAUSAL", "causal", "Causes", "Causality", "Causation", "Causal Relationships", "Causal Relationship", "Causative", "Cause", "cause", "Association & Causality",
        "Association & Causal", "Association & Causation", "Influence", "Influences", "Influenced by", "Influenced", "Affects", "Induces", "Direct", "Inverse", "Outcome", "Predictive", "Mediation",
        "Mediating", "Etiological", "Evidence Supporting", "Evidence-based", "Protective", "Treatment", "Intervention", "Involved in", "Causative Relationship", "Cause-effect",
    ],
    "Association": [
        "Association", "ASSOCIATION", "Associative", "associative", "Associational", "Associated", "ASSOCIATED", "Associated with", "associated with", "Associated With", "ASSOC",
        "Association Relationships", "Association Relationship", "Association & Linkage", "Association & Link", "Association & Correlation", "Association &", "Association & Structural",
        "Association & Feedback", "Association & Interaction", "Connection", "ASSOCIATIVE", "No association", "Negative association", "Negative Association", "Positive", "Comparison", "Compared",
        "Correlation", "Observational", "Relevant", "Evaluation", "Evidence-based", "Trend", "Process", "Descriptive", "Exploratory", "No Relationship", "associated", "Associative Relationships",
        "Relationship", "Associative Relationship", "Positive association", "Positive Association", "association",
    ],
    "Regulatory": ["Regulatory", "REGULATORY", "regulatory", "Regulate", "Regulatory Relationships", "Regulatory Relationship", "Regulates", "REG", "Regulation", "REGulatory"],
    "Structural/Belonging": [
        "Structural/Belonging", "Structural/Belonging Relationships", "Structural/Belonging Relationship", "structural/belonging", "STRUCTURAL/BELONGING", "structural/Belonging", "Part Relationship",
        "Structural", "structural", "STRUCTURAL", "Structural Relationship", "Structural relationship", "structural relationship", "Belonging", "BELONGING", "Belonging Relationships", "Belongs to",
        "Part-Whole", "Part of", "Part", "component of", "Component", "Subset", "Whole", "Instance", "Classification", "Part-of", "APP feature", "BELONGS_TO", "Structural/Biological",
    ],
    "Interaction & Feedback": [
        "Interaction & Feedback", "INTERACTION & FEEDBACK", "interaction & feedback", "Interaction & Feedback Relationships", "Interaction", "Feedback", "Association & Feedback",
        "Association & Interaction", "Competitive", "Connected", "INTERACTION &FEEDBACK",
    ],
}
CLASSES = ["BMC", "EGR", "ASPKM", "CRD", "APP", "SCN", "AAI", "CRBC", "NM", "EF"]
ALLOWED_RELATIONS = ["Causal", "Regulatory", "Interaction & Feedback", "Association"]
TYPE_PAIR_PRIOR = {("BMC", "EGR"): 1.0, ("BMC", "AAI"): 1.0, ("BMC", "ASPKM"): 0.95, ("BMC", "APP"): 0.80, ("BMC", "CRD"): 0.85, ("BMC", "NM"): 0.80, ("BMC", "SCN"): 0.75}
SAME_TYPE_PRIOR, OTHER_PRIOR = 0.7, 0.6
BAD_NAMES = [
    "patient", "patients", "subject", "subjects", "participant", "participants", "man", "men", "woman", "women", "male", "female", "males", "females", "yes", "no", "cohort", "group", "trial", "study", "studies",
    "control", "controls", "baseline", "outcome", "outcomes", "risk", "risks", "hazard", "dose", "dosing", "placebo", "visit", "year", "years", "month", "months", "day", "days", "up",
    "no - yes/no indicator", "tau - statistical technique", "standard error", "people",
]
NO_NAMES = ["na", "n/a", "none", "unknown"]
SYNONYM_TRIGGERS = {
    r"\bPGC[-\s]?1A\b": [r"\bPPARGC1A\b", r"\bPGC1A\b", r"PGC-?1α"],
    r"\bAMPK\b": [r"\bPRKAA1\b", r"\bPRKAA2\b", r"\bAMPK( pathway| signaling)?\b"],
    r"\bFOXO3\b": [r"\bFOXO-?3\b"],
    r"\bSIRT1\b": [r"\bSirtuin-?1\b"],
    r"\bMTOR\b": [r"\bmTOR\b", r"\bMTORC1\b", r"\bMTORC2\b", r"mTOR signaling"],
    r"\bRAPAMYCIN\b": [r"\bSirolimus\b"],
    r"\bCALORIC RESTRICTION\b": [r"\bCR\b", r"\bCalorie Restriction\b", r"\bDietary Restriction\b", r"\bDR\b"],
}
MODEL_LABELS = {
    "AgingRelated-DeepSeekR1-32B": "DeepSeekR1_32B", "AgingRelated-DeepSeekR1-7B": "DeepSeekR1_7B", "AgingRelated-DeepSeekV3": "DeepSeekV3",
    "JCRQ1-IF10-DeepSeekR1-32B": "DeepSeekR1_32B", "JCRQ1-IF10-DeepSeekR1-7B": "DeepSeekR1_7B", "JCRQ1-IF10-DeepSeekV3": "DeepSeekV3",
    "en_ner_bc5cdr_md": "SciSpacy_BC5CDR", "en_ner_bionlp13cg_md": "SciSpacy_BioNLP13CG", "en_ner_jnlpba_md": "SciSpacy_JNLPBA",
}
QUALITY_WEIGHTS = {"evidence_count": 0.35, "sources_unique": 0.25, "weight_sum": 0.25, "weight_max": 0.10, "weight_mean": 0.05, "default_hits": 0.10}


@dataclass(frozen=True)
class SourceWeights:
    """How a source field becomes a weight: keys, aliases, the default, and whether that is a floor."""

    weights: dict[str, float]
    aliases: dict[str, str]
    default: float
    floor: bool = False
    after_colon: bool = False

    def keys(self) -> list[str]:
        """The longest first; of equal lengths in the order given."""
        return sorted(self.weights, key=len, reverse=True)


ENTITY_SOURCES = SourceWeights(ENTITY_WEIGHTS, {"uniprot": "uniport", "ernie": "erine"}, 0.5, after_colon=True)
RELATION_SOURCES = SourceWeights(RELATION_WEIGHTS, {"uniprot": "opengenes"}, 0.5)
SUBGRAPH_SOURCES = SourceWeights(SUBGRAPH_WEIGHTS, {"uniprot": "opengenes"}, 0.4, floor=True)


@dataclass(frozen=True)
class Selection:
    primary_only: bool = True
    min_weight_norm: float | None = 0.60
    quantile: float = 0.85
    min_evidence: int = 2
    min_sources: int = 1
    ignore_case: bool = False


@dataclass(frozen=True)
class Aging:
    as_of: str
    threshold: float = 0.70
    half_life: float = 6.0
    alpha: float = 1.0
    use_journal: bool = True
    use_recency: bool = True
    top_articles: int = 3


@dataclass(frozen=True)
class Seeded:
    top_k: int = 25
    max_neighbours: int = 300
    min_count: int = 1
    quantile: float = 0.99
    pool: Selection = field(default_factory=lambda: Selection(min_sources=2))
    relations: tuple[str, ...] = tuple(ALLOWED_RELATIONS)
    top_edges: int | None = None
    min_quantile: float = 0.20


@dataclass(frozen=True)
class Mining:
    ppr: float = 0.6
    local: float = 0.4
    damping: float = 0.85
    tolerance: float = 1e-8
    max_iterations: int = 200
    neighbours: int = 6
    top_k: int = 200
