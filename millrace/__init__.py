"""millrace: corpus search, grounding and maintenance as lazy Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame; nothing in the
package collects rows to the driver unless the docstring names the bound.
"""

__version__ = "0.1.0"
