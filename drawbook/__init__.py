"""Reconciliation and scoring of dated measurement records, as Spark DataFrame jobs.

functions/  Column helpers built only from ``pyspark.sql.functions``
sources/    readers, dimensions, sinks and the views over the test tables
operators/  DataFrame-in, DataFrame-out operators
plans/      complete plans and the catalogue of runnable queries
streaming/  Structured Streaming jobs
"""
