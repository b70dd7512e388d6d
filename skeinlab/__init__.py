"""Skeinlab: Spark-first analytics over versioned symbols, graphs, vectors and documents."""
