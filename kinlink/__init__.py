"""kinlink: record linkage and corpus preparation as Spark DataFrame operators."""
