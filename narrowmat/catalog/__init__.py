"""The library's operations as queries over the shared test tables, each with
the SQL that gives the same answer."""
