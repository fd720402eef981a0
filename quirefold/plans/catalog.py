"""Every query of the library, and its SQL where there is any."""

from . import documents, glyphs, grids, scans, tables, texts

QUERIES = texts.QUERIES | grids.QUERIES | documents.QUERIES | glyphs.QUERIES | scans.QUERIES | tables.QUERIES
SQL = texts.SQL | grids.SQL | documents.SQL | glyphs.SQL | scans.SQL | tables.SQL
