"""ledgerkit: ledger analytics expressed as Spark DataFrame transforms."""
