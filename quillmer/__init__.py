"""A Spark-first engine for k-mer based classification of DNA sequences."""
