"""PySpark-native retrieval and learner-history analytics."""
