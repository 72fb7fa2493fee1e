"""Values, expressions and scalar functions as Columns."""
