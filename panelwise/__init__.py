"""Cohort analytics over coded survey tables, as Spark DataFrame builders."""
