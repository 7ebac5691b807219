"""tallyspark: business-analytics operators as plain DataFrame -> DataFrame functions.

Every operator is built from native Spark expressions so that Catalyst plans
the whole pipeline (predicate pushdown, column pruning, partial aggregation,
broadcast selection) and Tungsten executes it inside whole-stage codegen.
No Python UDFs are used anywhere in the library.
"""

__version__ = "0.1.0"
