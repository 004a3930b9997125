"""Assessment-growth analytics as Spark DataFrame operators.

``functions``  column expressions (missing values, bands, flags)
``operators``  DataFrame -> DataFrame building blocks
``plans``      the full indicator, release and check jobs
``sources``    declared schemas, readers and sinks
"""
