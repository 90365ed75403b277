"""Spark-native harmonisation of industrial material-master records."""
