"""Column functions: every one is a built-in expression tree, none is a Python UDF."""
