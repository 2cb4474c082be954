"""The operators bound to the shared test tables, each with the SQL that checks it."""
