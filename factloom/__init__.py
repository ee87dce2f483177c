"""factloom: Spark-native fact-decomposition and entailment analytics."""
