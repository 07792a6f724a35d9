"""oreline: a Spark-native engine for code-security analytics and training-data preparation.

Sub-packages
------------
``functions``  column expressions (text, paths, severities, hashes)
``operators``  DataFrame -> DataFrame operators
``sources``    readers and writers
``plans``      named queries over the test tables, each with its SQL where SQL can say it
``streaming``  Structured Streaming forms of the incremental operators
``llm``        operators on texts for training data; nothing outside imports it
"""
