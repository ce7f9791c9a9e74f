"""Training-data operators: ten corpus-scale building blocks and the queries that apply them.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; Python runs only inside
tasks, over Arrow batches that Spark partitions. What must be read twice is written to the folder that the cluster
names in ``spark.checkpoint.dir``.
"""
