"""sitesift: crawl, extract, index and search web captures with PySpark.

Everything is a DataFrame -> DataFrame or Column -> Column function; see
README.md for the module map.
"""

__version__ = "0.1.0"
