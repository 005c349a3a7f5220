"""corpuslens: labelled-text corpora and classifier evaluation on Spark."""

__version__ = "0.1.0"
