"""Mirrorloom: sequence-motif analytics expressed as Spark DataFrame stages."""
