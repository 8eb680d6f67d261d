"""Set-based assessment analytics on Spark: grading, review, evaluation and publishing."""
