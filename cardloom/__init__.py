"""cardloom: card catalogues, accounts, payments and event logs as Spark tables and streams."""
