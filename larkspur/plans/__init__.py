"""Lexer, parser, lowering, and the query catalogue."""
