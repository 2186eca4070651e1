"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Its functions travel to
the Python workers by value, so executors need only PySpark and the public
libraries, not an installed copy of this package.
"""

