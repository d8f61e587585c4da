"""Training-data operators over `documents`-shaped tables.

Each operator is a module with one public DataFrame -> DataFrame function (plus the plain
numpy/Python core that it maps over Arrow batches).  Nothing outside this package imports it.
"""
