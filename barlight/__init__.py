"""Spark-native market factor analytics and training-data operators."""
