"""legajo: Spark-native analytics over recognised document text.

Layers: ``functions`` (Column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and admission), ``plans`` (end-to-end
queries over the standard tables), ``streaming`` (Structured Streaming
versions).  Training-data operators live in the optional ``llm`` subpackage,
which nothing else here imports.
"""
