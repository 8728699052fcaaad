"""Column functions of the engine, by what they do."""

from graftwork.operators.lint import annotate
from graftwork.operators.matching import words
from graftwork.operators.scoring import bin_of, complexity_factor, composite, data_flow_tag, granularity, intensity
from graftwork.operators.trees import severity
from graftwork.sources.paths import detect_language, glob_match

__all__ = ["annotate", "bin_of", "complexity_factor", "composite", "data_flow_tag", "detect_language", "glob_match", "granularity", "intensity", "severity", "words"]
