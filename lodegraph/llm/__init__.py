"""Operations of a training-data pipeline on Spark DataFrames.

One module per operator; ``queries`` binds them to the test tables.  Nothing
outside this subpackage imports it.
"""
