"""Operations of a large-scale training-data pipeline.

One module per operator; ``registry`` holds their queries and SQL. Nothing
else in the library imports this subpackage.
"""
