"""tesserae: structure-aware matching, merging and templating of documents as Spark DataFrames."""
