"""Cohort, document and event analytics expressed as Spark jobs.

Every operator is a plain function from DataFrame(s) to DataFrame, built from
``pyspark.sql`` columns so that Catalyst plans the work.
"""
