"""From MySQL-flavoured SQL to Spark SQL: a tokenizer, an expression parser and statement rules. Catalyst does the planning."""
