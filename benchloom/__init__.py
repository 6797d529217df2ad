"""Model-evaluation and dataset-curation operators on Spark DataFrames.

Everything takes DataFrames (or Columns) and returns DataFrames (or Columns).
Nothing is collected to the driver unless a docstring says so and gives the
bound.  See README.md for the operator index.
"""

__version__ = "0.1.0"
