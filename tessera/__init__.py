"""tessera: a record-linkage and corpus-processing engine on Spark DataFrames."""

__version__ = "0.1.0"
