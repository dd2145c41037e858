"""Operators of a training-data pipeline.

Nothing outside this folder imports it; ``__spark_entry__`` registers
:func:`quarry.llm.registry.queries` when the folder is present.
"""
