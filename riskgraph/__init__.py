"""riskgraph: graph-based risk analytics as DataFrame-to-DataFrame functions on Spark."""
