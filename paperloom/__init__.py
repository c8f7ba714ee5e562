"""Paperloom: Spark-native analytics over corpora of loosely structured question papers."""
