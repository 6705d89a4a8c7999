"""granary: a Spark-first analytics engine for account-statement ledgers."""
