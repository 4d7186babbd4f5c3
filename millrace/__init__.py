"""millrace: batch analytics on Spark DataFrames.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column functions), ``operators`` (DataFrame to
DataFrame), ``plans`` (job specs and the query catalogue), ``streaming`` and the optional ``llm`` (operators for
training data, which nothing else here imports).
"""
