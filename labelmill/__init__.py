"""labelmill: labelled document corpora as Spark DataFrames."""

from labelmill.config import PRESETS, CorpusConfig, evaluation, needed_years

__all__ = ["PRESETS", "CorpusConfig", "evaluation", "needed_years"]
