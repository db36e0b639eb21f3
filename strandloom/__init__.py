"""strandloom: haplotype-aware chromatin contact analytics on Spark DataFrames."""

__version__ = "0.1.0"
