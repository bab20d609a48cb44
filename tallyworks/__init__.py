"""Spark-first expense-ledger analytics: extraction, checks, rules, ledger, reports."""
