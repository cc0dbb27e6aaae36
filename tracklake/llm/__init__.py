"""Operators for building text training sets.

The subpackage stands alone: nothing else in the library imports it, and it
needs only Spark, numpy, pyarrow and (for two operators) ``tokenizers``.
"""
