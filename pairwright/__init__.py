"""Preference-pair preparation, evaluation and ensembling as Spark DataFrame operators."""
