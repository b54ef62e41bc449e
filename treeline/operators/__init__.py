"""The relational operators that plans compile to; all are lazy DataFrame expressions."""
