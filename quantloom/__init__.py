"""quantloom: a Spark-native engine for quantitative market research."""
