"""Training-data operators: each module holds one operator, ``catalog`` its queries.

Nothing else in the library imports this package.  Operators take a table with an
integer id and a text column (names are parameters), read only the columns they
name and return only the columns they document, so further columns of the input,
whatever their names, neither matter nor clash.
"""
