"""mentionforge: research-text mentions, linkage, corpus hygiene and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
