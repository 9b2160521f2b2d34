"""Rule tables of the deterministic claim rules. Fixed values; tests may pass other tables."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lexicon:
    """Ordered rule lists: the first that fits decides."""

    shortcut: tuple[str, ...] = (
        r"as described (?:previously|in)",
        r"as (?:previously )?described",
        r"following the (?:protocol|method) of",
        r"following [A-Z][a-z]+ (?:et al\.?)?",
        r"see (?:supplementary|ref\.?|references?) for",
        r"performed as in",
        r"per the procedure of",
        r"\(ref_\d+\)",
    )
    standard: tuple[str, ...] = (
        r"standard (?:conditions|protocol|methods?)",
        r"as is conventional",
        r"according to manufacturer'?s instructions",
        r"per (?:the )?manufacturer",
    )
    partial: tuple[str, ...] = ("briefly", "in brief", "approximately")
    types: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("analysis", ("t-test", "anova", "regression", "p <", "p<", "p =", "statistical", "graphpad", "spss", "r version")),
        ("software", ("python", "version", "r (", "matlab", "fiji", "imagej", "github.com")),
        ("dataset", ("dataset", "geo accession", "sra", "zenodo", "doi.org/10.")),
        ("sample_prep", ("fixed", "stained", "lysed", "harvested", "cultured", "transfected")),
        ("procedure", ("incubated", "centrifuged", "washed", "added", "mixed")),
        ("equipment", ("microscope", "spectrometer", "illumina", "cytometer", "centrifuge", "pcr machine")),
        ("reagent", ("buffer", "antibody", "dmem", "fbs", "pbs", "tris", "edta")),
    )
    concentration: str = r"(?:^|[^\p{L}\p{N}_])[0-9]+(?:\.[0-9]+)?\s*(?:mm|um|nm|molar)(?:$|[^\p{L}\p{N}_])"
    ref_id: str = r"\[(ref_?[0-9]+|bib[0-9]+|b[0-9]+|r[0-9]+|[0-9]+)\]"


DEFAULT = Lexicon()

#: Words without weight when two claims are compared.
OVERLAP_STOP = tuple(
    "using with from were was that this following briefly standard above described used method methods cell cells tissue section sections sample samples human humans mouse mice tumor tumors tumour tumours hour hours minute minutes well wells plate plates".split()
)
ABBREVIATIONS = "et al|e\\.g|i\\.e|fig|eq|dr|mr|mrs|ms|prof|vs|no|st|inc|co|corp|ltd"
SECTION_OF_TYPE = {"reagent": "reagents", "equipment": "equipment", "sample_prep": "sample_prep", "procedure": "procedure", "analysis": "analysis", "parameter": "procedure", "software": "software", "dataset": "datasets"}
ACTION_OF_GAP = {
    "depth_exceeded": "Inspect the final citation-chain step manually.",
    "source_unavailable": "Locate an accessible full-text copy or request the protocol from the authors.",
    "reference_unresolved": "Resolve the bibliography entry to a DOI or stable paper identifier.",
    "no_match_in_cited": "Review the cited paper manually; retrieved methods passages did not support the claim.",
    "no_reference": "The source gives no traceable reference; contact the authors for procedural detail.",
}
ACTION_DEFAULT = "Inspect the source document and extraction manually."
SECTION_ORDER = ("reagents", "equipment", "sample_prep", "procedure", "analysis", "software", "datasets")
TYPES = ("reagent", "equipment", "sample_prep", "procedure", "analysis", "parameter", "software", "dataset")
SPECIFICITIES = ("fully_described", "partially_described", "shortcut_citation", "standard_unspecified")
STATUSES = ("unresolved", "resolved", "inferred", "terminal_gap", "skipped")
GAP_REASONS = ("source_unavailable", "reference_unresolved", "no_match_in_cited", "no_reference", "depth_exceeded", "parsing_failed", "paywall_or_dead")


@dataclass(frozen=True)
class Weights:
    """Weights of the weighted coverage and credit for partial evidence."""

    by_type: dict = field(default_factory=lambda: {"reagent": 1.0, "equipment": 1.0, "sample_prep": 1.0, "procedure": 1.0, "analysis": 1.0, "parameter": 1.0, "software": 1.0, "dataset": 1.0})
