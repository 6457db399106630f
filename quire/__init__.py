"""quire: a PySpark engine for catalogues of scanned pages.

The catalogue tier (sources, pages, edit operations, versions) is plain DataFrame code; the raster
tier holds one image per row and works on it with Arrow batches and numpy.
"""

__version__ = "0.1.0"
