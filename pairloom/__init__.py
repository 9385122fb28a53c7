"""Document-pair analytics on Spark: blocking, scoring, review selection and their evaluation."""
