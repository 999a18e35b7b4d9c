"""The dialect: lexer, parser, and lowering to Spark SQL."""
