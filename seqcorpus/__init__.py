"""Spark-native preparation and evaluation of sequence-labelling corpora."""
