"""Spark-native scanner for secrets and personal data, with training-data operators beside it."""
