"""Spark-native synthetic genotype simulation that keeps linkage disequilibrium."""
