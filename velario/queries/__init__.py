"""All registered queries over the given tables, with the SQL they are held against."""

from velario.queries import governance, identifiers, relational

QUERIES = identifiers.QUERIES | relational.QUERIES | governance.QUERIES
ORACLES = identifiers.ORACLES | relational.ORACLES | governance.ORACLES
