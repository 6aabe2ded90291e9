"""pagewright: a Spark-first analytics engine for page-addressed text corpora."""
