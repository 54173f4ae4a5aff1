"""Connected exposure and credit risk of a lending book, as Spark DataFrames.

Five plain tables (entities, loans, guarantees, collateral, limits) form a
:class:`~linkbook.book.Book`; the modules in :mod:`linkbook.operators` are
functions from a book to a DataFrame.
"""

from linkbook.book import Book
from linkbook.session import session

__all__ = ["Book", "session"]
