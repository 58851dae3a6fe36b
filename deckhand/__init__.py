"""deckhand: a Spark-native engine for presentation packages, record pipelines and training text."""
