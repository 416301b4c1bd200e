"""Spark-native market-scan analytics and training-data operators."""
