"""All queries of the library but those of the optional subpackage."""

from gradus.plans import annotated, asked, drawn, queries

QUERIES = {**queries.QUERIES, **annotated.QUERIES, **asked.QUERIES, **drawn.QUERIES}
SQL = {**queries.SQL, **annotated.SQL, **asked.SQL, **drawn.SQL}
