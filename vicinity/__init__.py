"""Spark-native nearest-neighbour fraud scoring: features, exact k-NN joins, decisions and evaluation."""
