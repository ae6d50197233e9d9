"""Dataset curation, evaluation and corpus preparation as Spark DataFrame operators."""
