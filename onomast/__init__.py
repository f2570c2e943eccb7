"""A Spark-native engine for screening names and for preparing text corpora."""
