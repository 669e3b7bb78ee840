"""Document corpora and dated plans on Spark: cleaning, chunking, ranking, answer checks, evaluation, scheduling."""
