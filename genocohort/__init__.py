"""Cohort-scale genomic scoring and screening as Spark DataFrame plans."""
