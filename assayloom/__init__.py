"""assayloom: iterative screening analytics written as Spark DataFrame jobs."""
