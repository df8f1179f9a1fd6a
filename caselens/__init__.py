"""Log-investigation engine on PySpark.

Log files become one ``events`` DataFrame and one ``entities`` DataFrame; every
question after that is a DataFrame transform on those two tables.
"""

from .session import build_session, configure

__all__ = ["build_session", "configure"]
