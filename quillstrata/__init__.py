"""Evidence-grounded document analytics expressed as Spark DataFrames."""
