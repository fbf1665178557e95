"""loomspark: a Spark-first engine for document retrieval workloads."""
