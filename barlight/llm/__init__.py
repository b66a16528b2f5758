"""Training-data operators: scans, joins, packing and mixing over text tables.

Nothing else in the library imports this subpackage.
"""
