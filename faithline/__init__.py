"""faithline: a Spark-native engine for causal evaluation of structured reasoning, and training-data operators."""
