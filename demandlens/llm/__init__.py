"""Training-data operators: each module holds one operator, ``queries`` the
registered queries over the given tables.  Nothing else in the library
imports this package."""
